"""Texts of public licences that files are compared with."""

from __future__ import annotations

from typing import NamedTuple


class Template(NamedTuple):
    """A licence, the terms without which a unit is not this licence, and a notice, header, opening or whole text."""

    license: str
    must: str
    text: str


_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_REST = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.
"""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE_FIRST = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License."""
_APACHE_REST = """You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""
_GNU = """This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public
License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any
later version."""
_GNU_REST = """This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details.

You should have received a copy of the GNU {kind}General Public License along with this {work}. If not, see
<https://www.gnu.org/licenses/>."""
_GNU_FILE = """GNU {kind}GENERAL PUBLIC LICENSE Version {version}, {date}

Copyright (C) {year} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this
license document, but changing it is not allowed."""
_CC = """Creative Commons {title} International Public License By exercising the Licensed Rights (defined below), You accept and
agree to be bound by the terms and conditions of this Creative Commons {title} International Public License ("Public
License")."""
_CC_LINK = "This work is licensed under a Creative Commons {title} International License. https://creativecommons.org/licenses/{short}/4.0/"


def _gnu(license: str, work: str, kind: str, version: str, date: str, year: str) -> list[Template]:
    must = f"{kind} general public {version}".lower().strip()
    v = {"work": work, "kind": f"{kind} " if kind else "", "version": version}
    notice = _GNU.format(**v)
    head = _GNU_FILE.format(**(v | {"kind": v["kind"].upper()}), date=date, year=year)
    return [Template(license, must, notice), Template(license, must, notice + "\n\n" + _GNU_REST.format(**v)), Template(license, must, head)]


#: Usual notices, headers, openings and whole texts of public licences.
TEMPLATES: tuple[Template, ...] = (
    Template("MIT", "mit", "Released under the MIT License."),
    Template("MIT", "mit", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    Template("MIT", "hereby granted", _MIT_GRANT),
    Template("MIT", "hereby granted", _MIT_GRANT + "\n\n" + _MIT_REST),
    Template("MIT", "hereby granted", "MIT License\n\nCopyright (c)\n\n" + _MIT_GRANT + "\n\n" + _MIT_REST),
    Template("BSD-3-Clause", "bsd", "Use of this source code is governed by a BSD-style license; redistribution and use in source and binary forms are permitted."),
    Template("BSD-3-Clause", "bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    Template("BSD-2-Clause", "redistributions binary", _BSD_START + "\n" + _BSD_END),
    Template("BSD-3-Clause", "redistributions binary endorse", _BSD_START + "\n" + _BSD_THIRD + "\n" + _BSD_END),
    Template("Apache-2.0", "apache", "Licensed under the Apache License, Version 2.0."),
    Template("Apache-2.0", "apache", _APACHE_FIRST),
    Template("Apache-2.0", "apache", _APACHE_FIRST + " " + _APACHE_REST),
    Template("Apache-2.0", "apache 2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    Template("GPL-2.0", "general public 2", "This program is licensed under the GNU General Public License, version 2."),
    Template("GPL-3.0", "general public 3", "This work is licensed under the GNU General Public License, version 3."),
    Template("LGPL-3.0", "lesser general public 3", "This library is licensed under the GNU Lesser General Public License, version 3."),
    Template("AGPL-3.0", "affero general public 3", "This program is licensed under the GNU Affero General Public License, version 3."),
    *_gnu("GPL-2.0", "program", "", "2", "June 1991", "1989, 1991"),
    *_gnu("GPL-3.0", "program", "", "3", "29 June 2007", "2007"),
    *_gnu("LGPL-2.1", "library", "Lesser", "2.1", "February 1999", "1991, 1999"),
    *_gnu("LGPL-3.0", "library", "Lesser", "3", "29 June 2007", "2007"),
    *_gnu("AGPL-3.0", "program", "Affero", "3", "19 November 2007", "2007"),
    Template("MPL-2.0", "mozilla 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    Template("MPL-2.0", "mozilla 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    Template("MPL-2.0", "mozilla 2.0", "Mozilla Public License Version 2.0"),
    Template("EPL-2.0", "eclipse 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    Template("ISC", "fee hereby granted", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("Zlib", "misrepresented altered", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
    Template("BSL-1.0", "boost", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    Template("Unlicense", "unencumbered public domain", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    Template("CC0-1.0", "cc0", "To the extent possible under law, the author has waived all copyright: CC0 1.0 Universal public domain dedication."),
    Template("CC0-1.0", "waived rights", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    Template("CC-BY-4.0", "cc by 4.0", "Licensed under CC BY 4.0, Creative Commons Attribution."),
    Template("CC-BY-NC-4.0", "cc by nc 4.0", "Licensed under CC BY-NC 4.0."),
    Template("CC-BY-SA-4.0", "cc by sa 4.0", "Licensed under CC BY-SA 4.0."),
    *(
        Template(f"CC-{short.upper()}-4.0", f"{must} 4.0", text.format(title=f"{title} 4.0", short=short))
        for short, must, title in (
            ("by", "attribution", "Attribution"),
            ("by-nc", "attribution noncommercial", "Attribution-NonCommercial"),
            ("by-sa", "attribution sharealike", "Attribution-ShareAlike"),
        )
        for text in (_CC, _CC_LINK)
    ),
    *(
        Template(license, f"spdx {must}", f"SPDX-License-Identifier: {tag}")
        for license, must, tags in (
            ("MIT", "mit", "MIT"),
            ("BSD-2-Clause", "bsd 2 clause", "BSD-2-Clause"),
            ("BSD-3-Clause", "bsd 3 clause", "BSD-3-Clause"),
            ("Apache-2.0", "apache 2.0", "Apache-2.0"),
            ("GPL-2.0", "gpl 2.0", "GPL-2.0 GPL-2.0-only GPL-2.0-or-later"),
            ("GPL-3.0", "gpl 3.0", "GPL-3.0 GPL-3.0-only GPL-3.0-or-later"),
            ("LGPL-2.1", "lgpl 2.1", "LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later"),
            ("LGPL-3.0", "lgpl 3.0", "LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later"),
            ("AGPL-3.0", "agpl 3.0", "AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later"),
            ("MPL-2.0", "mpl 2.0", "MPL-2.0"),
            ("EPL-2.0", "epl 2.0", "EPL-2.0"),
            ("ISC", "isc", "ISC"),
            ("Zlib", "zlib", "Zlib"),
            ("BSL-1.0", "bsl 1.0", "BSL-1.0"),
            ("Unlicense", "unlicense", "Unlicense"),
            ("CC0-1.0", "cc0 1.0", "CC0-1.0"),
            ("CC-BY-4.0", "cc by 4.0", "CC-BY-4.0"),
            ("CC-BY-SA-4.0", "cc by sa 4.0", "CC-BY-SA-4.0"),
        )
        for tag in tags.split()
    ),
    Template("Proprietary", "reserved", "All rights reserved."),
)
#: Says that rights are kept, which a licence in the same file may grant after all: it counts only where nothing else does.
RESERVATION = "Proprietary"

"""Dedup, mixing, sharding, quality rules and licenses on small tables: edge cases and brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from netloom.llm import exact_dedup as ed
from netloom.llm import near_dup as nd
from netloom.llm.components import components
from netloom.llm.exact_dedup import drop_exact_duplicates, exact_dedup
from netloom.llm.license_texts import TEMPLATES
from netloom.llm.licenses import anchors, inherit, scan, score, terms
from netloom.llm.mixing import mix, mixed_rows, targets
from netloom.llm.near_dup import drop_near_duplicates, least_matches, near_duplicates, shingles
from netloom.llm.quality import cleaned, measure
from netloom.llm.sharding import shard_by_bytes, write_shards

SCHEMA = "doc_id long, text string, source string, norm string, salt int"
EDGES = [(3, "a  b", "s", "n", 1), (1, "a\tb", "s", "n", 2), (3, "a  b", "s", "n", 1), (None, "a b", None, None, 3), (5, None, "s", "", 4), (4, "", "s", "", 5), (9, " x ", "t", "", 6), (8, "long " * 60_000, "t", "", 7)]


def _key(v):  # noqa: ANN001, ANN202
    return (v is None, v)


@pytest.fixture(scope="module")
def edges(spark):  # noqa: ANN001, ANN201
    return spark.createDataFrame(EDGES, SCHEMA)


# Exact dedup.


def test_exact_dedup_edges(spark, edges) -> None:  # noqa: ANN001
    got = exact_dedup(edges).collect()
    assert len(got) == len(EDGES)
    assert sum(r["kept"] for r in got) == 4
    one = [r for r in got if r["group_size"] == 4]
    assert {r["keep_id"] for r in one} == {1} and len(one) == 4
    assert {r["text_sha256"] for r in one} == {hashlib.sha256(b"a b").hexdigest()}
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in got if r["group_size"] == 2} == {(4, 4, True), (5, 4, False)}
    assert exact_dedup(edges.limit(0)).count() == 0
    rest = drop_exact_duplicates(edges)
    assert rest.columns == edges.columns and sorted(r["doc_id"] for r in rest.collect()) == [1, 4, 8, 9]


def test_exact_dedup_with_hot_texts(spark, monkeypatch) -> None:  # noqa: ANN001
    rng = random.Random(1)
    rows = [(k, rng.choice(["hot  text", "hot text", "warm", f"own {k % 700}"])) for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert ed._hot(df.select(ed.collapsed(F.col("text")).alias("norm")), 4000, 4)
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"\s+", " ", t)].append(d)
    want = {d: (min(groups[re.sub(r"\s+", " ", t)]), len(groups[re.sub(r"\s+", " ", t)])) for d, t in rows}
    for hot in (True, False):
        if not hot:
            monkeypatch.setattr(ed, "_hot", lambda *a: [])
        got = exact_dedup(df).collect()
        assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got} == want
        assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)
    assert drop_exact_duplicates(df).count() == len(groups)


# Near dedup.


def _brute(docs: dict[int, str], pct: int = 75) -> dict[int, int]:
    def sets(t: str | None) -> frozenset:
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    s, parent = {d: sets(t) for d, t in docs.items()}, {d: d for d in docs}

    def root(d: int) -> int:
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(s[a] & s[b])
            if both and 100 * both >= pct * (len(s[a]) + len(s[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d in docs}


def _copies(seed: int, n: int, edits: tuple[int, int], words: int = 80) -> list[str]:
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        c = list(base)
        for _ in range(rng.randint(*edits)):
            c[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(c))
    return out


def test_near_duplicates_against_brute_force(spark) -> None:  # noqa: ANN001
    texts = _copies(1, 120, (0, 4)) + _copies(2, 30, (0, 2)) + _copies(3, 30, (2, 6)) + ["short one", "Short ONE", "", None, "a b c d e", "a b c d f"]
    rng = random.Random(0)
    rng.shuffle(texts)
    docs = dict(enumerate(texts))
    got = near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == _brute(docs)
    assert all(r["n_shingles"] == len(shingles(docs[r["doc_id"]])) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_in_several_blocks(spark, monkeypatch) -> None:  # noqa: ANN001
    monkeypatch.setattr(nd, "BLOCK", 16)
    docs = dict(enumerate(_copies(5, 90, (3, 7))))
    got = near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == _brute(docs)


def test_near_duplicates_in_a_crowded_band(spark, monkeypatch) -> None:  # noqa: ANN001
    """Texts that share a long template fall into common bands without being linked; links between them are found, with
    small blocks, blocks of few shingles and bands joined by a shuffle."""
    monkeypatch.setattr(nd, "BLOCK", 8)
    monkeypatch.setattr(nd, "BLOCK_SHINGLES", 4000)
    monkeypatch.setattr(nd, "BROADCAST_BANDS", 0)
    rng = random.Random(11)
    template = [f"t{i}" for i in range(120)]
    texts = [" ".join(template + [f"o{k}x{i}" for i in range(70)]) for k in range(80)]
    texts += [" ".join(template + [f"o{k}x{i}" for i in range(70 + rng.randint(0, 60))]) for k in range(0, 80, 3)]
    texts += [" ".join(template + [f"o{k}x{i}" for i in range(55)] + ["end"] * 3) for k in range(0, 80, 7)]
    docs = dict(enumerate(texts))
    got = near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == _brute(docs)


def test_near_duplicates_edges(spark, edges) -> None:  # noqa: ANN001
    got = near_duplicates(edges).collect()
    assert len(got) == len(EDGES)
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter([(3, 1), (1, 1), (3, 1), (None, 1), (5, 5), (4, 4), (9, 9), (8, 8)])
    assert near_duplicates(edges.limit(0)).count() == 0
    assert drop_near_duplicates(edges).columns == edges.columns


def test_near_duplicates_with_shared_and_null_identifiers(spark) -> None:  # noqa: ANN001
    near, own = _copies(7, 6, (1, 1)), [t for k in range(20, 24) for t in _copies(k, 1, (0, 0))]
    rows = [(2, near[0]), (7, near[1]), (7, own[0]), (7, own[1]), (None, near[2]), (None, near[3]), (2, own[2]), (None, own[3]), (9, near[4]), (9, near[5]), (None, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("x"))
    want = Counter([(2, near[0]), *(r for r in rows if r[1] not in near)])
    out = drop_near_duplicates(df)
    assert out.columns == df.columns and Counter((r["doc_id"], r["text"]) for r in out.collect()) == want
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect())
    assert got == Counter([(2, 2, True), (7, 2, False), (None, 2, False), (None, 2, False), (9, 2, False), (9, 2, False), (7, 7, True), (7, 7, True), (2, 2, True), (None, None, True), (None, None, True), (9, 9, True)])


def test_pruning_bounds() -> None:
    least = [least_matches(n, 0.75, 1e-4) for n in (32, 64, 96, 128)]
    assert least == sorted(least) and all(m < 0.75 * n for m, n in zip(least, (32, 64, 96, 128), strict=True))
    rng = np.random.default_rng(0)
    kept = np.mean((rng.random((200_000, 128)) < 0.75).cumsum(axis=1)[:, [31, 63, 95, 127]] >= least, axis=0)
    assert (kept > 0.998).all()


def test_components_of_a_long_path(spark) -> None:  # noqa: ANN001
    order = list(range(60))
    random.Random(3).shuffle(order)
    e = [(a, b) for a, b in zip(order, order[1:], strict=False)] + [(100, 101), (102, 101)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(e, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(60), 0), 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# Mixing.


def test_targets(spark) -> None:  # noqa: ANN001
    rows = [("a", 10), ("b", 1000), ("c", 5), (None, 40), ("d", 0)]
    got = {r["source"]: r for r in targets(spark.createDataFrame(rows, "source string, source_size long")).collect()}
    total, weight = 1055, {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    full: set = set()
    while True:
        rest, w = total - sum(3 * dict(rows)[s] for s in full), sum(v for s, v in weight.items() if s not in full)
        want = {s: 3 * dict(rows)[s] if s in full else weight[s] * rest / w for s in weight}
        over = {s for s in weight if s not in full and want[s] > 3 * dict(rows)[s]}
        if not over:
            break
        full |= over
    assert {s: r["target"] for s, r in got.items()} == pytest.approx(want)


def test_mix_cuts_exactly(spark) -> None:  # noqa: ANN001
    rng = random.Random(4)
    rows = [(k, " ".join(["w"] * rng.randint(0, 50)), rng.choice(["a", "b", "b", "b", None, "c"])) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(df).collect()
    source, by = {k: s for k, _, s in rows}, defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[source[r["doc_id"]]] += r["taken"]
    assert all(by[source[r["doc_id"]]] == int(r["target"] + 0.5) for r in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix(df.repartition(7)).collect()))
    out = mixed_rows(df)
    assert out.columns == df.columns
    n = defaultdict(int)
    for r in out.collect():
        n[r["doc_id"]] += len(r["text"].split())
    assert {k: v for k, v in n.items() if v} == {r["doc_id"]: r["taken"] for r in got if r["taken"]}


def test_mix_edges(spark, edges) -> None:  # noqa: ANN001
    got = mix(edges).collect()
    assert len(got) == len(EDGES) and mix(edges.limit(0)).count() == 0
    assert mixed_rows(edges).columns == edges.columns


def test_mixed_rows_with_shared_and_null_identifiers(spark) -> None:  # noqa: ANN001
    rng = random.Random(11)
    rows = [(rng.choice([None, k % 40]), f"row{k} " + " ".join(["w"] * rng.randint(0, 30)), s) for s in ("a", "b", "c") for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").select("doc_id", "text", F.col("row").alias("source"), F.lit(1).alias("row"))
    budget, size, taken = {}, defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        size[s] += len(t.split())
    for r in targets(spark.createDataFrame(list(size.items()), "source string, source_size long")).collect():
        budget[r["source"]] = r["budget"]
    seen = Counter()
    for r in mixed_rows(df).collect():
        taken[r["source"]] += len(r["text"].split())
        seen[(r["doc_id"], r["source"], r["text"].split()[0])] += 1
    assert taken == budget
    whole = {s: budget[s] // size[s] for s in size}
    assert all(whole[s] <= seen[(d, s, t.split()[0])] <= whole[s] + 1 for d, t, s in rows)


# Sharding.


def test_shards(spark, edges, tmp_path) -> None:  # noqa: ANN001
    rng = random.Random(2)
    rows = [(k * 3 % 1000, "é" * rng.randint(0, 90)) for k in range(1000)]
    got = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["shard"] for r in got] == sorted(r["shard"] for r in got)
    size, slots = Counter(), defaultdict(list)
    for r in got:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        text = dict(rows)[r["doc_id"]]
        assert r["size"] == len(text.encode()) + 1 and r["text_crc32"] == zlib.crc32(text.encode())
    assert set(size) == set(range(8)) and max(size.values()) - min(size.values()) <= 2 * 181
    assert all(v == list(range(len(v))) for v in slots.values())
    assert len(shard_by_bytes(edges).collect()) == len(EDGES) and shard_by_bytes(edges.limit(0)).count() == 0
    write_shards(edges, str(tmp_path / "out"), 3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(EDGES)


# Quality rules.


def test_quality_base(spark) -> None:  # noqa: ANN001
    rng = random.Random(6)
    texts = [None, "", "a a a a", "x y z x y z", "a b\na b\n \na b", "é#$ *|<>&% ü", " ".join(rng.choice("abcd") for _ in range(200)), "one two three " * 40]
    texts += [" ".join(rng.choice(["a", "b", "c", "d", "e", "f", "g"]) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    got = {r["doc_id"]: r for r in measure(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, t in enumerate(texts):
        t = t or ""
        w = t.split()
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = {g for g, n in Counter(grams).items() if n > 1}
        covered = len({i + j for i, g in enumerate(grams) if g in often for j in range(3)})
        lines = [x for x in t.split("\n") if x.strip()]
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), covered, len(lines) - len(set(lines))), t
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
        assert r["base_failed"] == (len(w) < 50 or 100 * covered > 50 * len(w))


def test_site_phrases_in_four_languages(spark) -> None:  # noqa: ANN001
    good = "\n".join(f"A sentence of text number {k} with words of its own stands here and ends." for k in range(6))
    phrases = ["Click here to go on with the story.", "Alle Rechte vorbehalten.", "TOUS DROITS RÉSERVÉS.", "Política de privacidad del sitio.", "Jetzt anmelden und mehr lesen."]
    near = ["Hier war ein Klick zu hören.", "Les droits de tous sont importants.", "Los derechos de todos importan."]
    rows = [(k, good + "\n" + x) for k, x in enumerate(phrases + near)]
    got = {r["doc_id"]: r["clean_text"] for r in measure(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] == (good if k < len(phrases) else t) for k, t in rows] == [True] * len(rows)


def test_quality_lines(spark, edges) -> None:  # noqa: ANN001
    good = " ".join(f"word{i}" for i in range(60)) + "."
    bad = "\n".join(["Home | News | About", "LOUD!! NOISE!! HERE!!", "Accept our cookie policy now.", "no end", good])
    noisy = "\n".join([" ".join(f"no{i}###" for i in range(70)) + ".", "Clean end of it all."])
    df = spark.createDataFrame([(1, good, "k"), (2, bad, "k"), (3, noisy, "k"), (4, None, None)], "doc_id long, text string, row string")
    out = {r["doc_id"]: r for r in cleaned(df).collect()}
    assert set(out) == {1, 2} and out[2]["text"] == good and out[2]["row"] == "k"
    assert measure(edges).count() == len(EDGES) and measure(edges.limit(0)).count() == 0
    assert measure(df).filter("n_repeat_words = 0 AND kept").count() == 2


#: A sentence, a menu line, and a line that stays without a mark (or none), by script.
_SCRIPTS = {
    "Chinese": ("第{k}个句子在这里讲述了一个关于河流和山脉的完整故事。", "首页 新闻 登录", "这是一段没有结尾标点但是相当长的文字它讲述了很多事情而且一直没有停下来直到最后"),
    "Japanese": ("これは{k}番目の文であり、川と山についての短い物語を語っています。", "ホーム ニュース ログイン", None),
    "quoted Japanese": ("彼は「{k}番目の山はとても高いです」", "ホーム ニュース", None),
    "Arabic": ("هل تعرف قصة النهر والجبل رقم {k} التي رواها الناس؟", "الرئيسية أخبار دخول", None),
    "Urdu": ("یہ دریا اور پہاڑ کی کہانی نمبر {k} ہے۔", "صفحہ اول خبریں", None),
    "Hindi": ("यह नदी और पहाड़ की कहानी संख्या {k} है।", "मुख्य पृष्ठ समाचार", None),
    "Thai": ("นี่คือประโยคที่ {k} ซึ่งเล่าเรื่องของแม่น้ำและภูเขาที่สวยงามมากแห่งหนึ่งในประเทศนี้", "หน้าแรก ข่าว", None),
    "Greek": ("Αυτή είναι η ιστορία αριθμός {k} για το ποτάμι και το βουνό;", "Αρχική Νέα", None),
    "Russian": ("Это рассказ номер {k} о реке и о горе.", "Главная Новости Вход", None),
    "Armenian": ("Սա գետի և լեռան մասին պատմություն է {k}։", "Գլխավոր Նորություններ", None),
    "Amharic": ("ይህ ስለ ወንዝ እና ተራራ ታሪክ ቁጥር {k} ነው።", "መነሻ ዜና", None),
    "Khmer": ("នេះគឺជារឿងទី{k}អំពីទន្លេនិងភ្នំដ៏ស្រស់ស្អាត។", "ទំព័រដើម ព័ត៌មាន", None),
    "German": ("Er sagte: „Dies ist der Satz mit der Nummer {k}.“", "Startseite Neues", None),
}


def test_quality_keeps_a_chinese_text(spark) -> None:  # noqa: ANN001
    text = "\n".join(_SCRIPTS["Chinese"][0].format(k=k) for k in range(121))
    r = measure(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r["n_words"], r["clean_words"], r["kept"]) == (121, 121, True)


@pytest.mark.parametrize("script", sorted(_SCRIPTS))
def test_quality_of_scripts(spark, script: str) -> None:  # noqa: ANN001
    """Many sentences of a script stay, its menu lines go."""
    sentence, menu, unmarked = _SCRIPTS[script]
    good = [sentence.format(k=k) for k in range(121)] + ([unmarked] if unmarked else [])
    text = "\n".join([menu, *good, " | ".join(menu.split()) + " |"])
    r = measure(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["clean_text"].split("\n") == good and r["kept"] == (not r["base_failed"])
    noisy = spark.createDataFrame([(1, "\n".join("#$%&" * 12 + " ".join("#" + w for w in x.split()) for x in good))], "doc_id long, text string")
    assert measure(noisy).first()["clean_words"] == 0


# Licenses.


def test_anchors_lose_nothing() -> None:
    vectors, musts = [terms(t.text) for t in TEMPLATES], [set(t.must.split()) for t in TEMPLATES]
    assert all(must and must <= set(own) for own, must in zip(vectors, musts, strict=True))
    for spread in (1.0, 3.0, 40.0):
        idf = {t: 1.0 + len(t) / spread for own in vectors for t in own}
        near = anchors(vectors, musts, idf, 0.7)
        for own, must in zip(vectors, musts, strict=True):
            rest = [t for t in own if t not in near]
            assert must & near or sum((own[t] * idf[t]) ** 2 for t in rest) < 0.49 * sum((n * idf[t]) ** 2 for t, n in own.items())


_BSD3 = """Copyright (c) 2011, The Example Authors. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

   * Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
   * Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the
distribution.
   * Neither the name of Example Inc. nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR
A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
OWNER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
_GPL3 = """ * Frob is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * Frob is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 *
 * You should have received a copy of the GNU General Public License
 * along with Frob.  If not, see <http://www.gnu.org/licenses/>.
"""
_MIT = """The MIT License (MIT)

Copyright (c) 2009-2014 Jane Q. Public and contributors

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
_APACHE = """# Copyright 2015 The Frob Authors. All Rights Reserved.
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
# ======================================================================
"""
_CODE = "import os\n\n\ndef main(a, b):\n    # all rights of the rest\n    return os.path.join(a, b)\n"
_GPL_OPENING = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The long text goes on from here with words of its own."""
#: (text, licence): as they stand in files, in other words and line breaks than the templates.
REAL = [
    (_MIT, "MIT"),
    ("#!/usr/bin/env python\n" + "".join(f"# {x}\n".replace("# \n", "#\n") for x in _MIT.splitlines()) + _CODE, "MIT"),
    ("/*\n" + "".join(f" * {x}\n" for x in _MIT.splitlines()[4:10]) + " */\n" + _CODE, "MIT"),
    (_BSD3, "BSD-3-Clause"),
    ("\n".join(_BSD3.splitlines()[:11] + _BSD3.splitlines()[14:]), "BSD-2-Clause"),
    ("\n".join("// " + x for x in _BSD3.splitlines()) + "\n" + _CODE, "BSD-3-Clause"),
    (_APACHE + _CODE, "Apache-2.0"),
    ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "Apache-2.0"),
    ("/*\n" + _GPL3 + " */\n" + _CODE, "GPL-3.0"),
    (_GPL3.replace("General Public", "Lesser General Public"), "LGPL-3.0"),
    (_GPL3.replace("General Public", "Affero General Public"), "AGPL-3.0"),
    (_GPL3.replace("version 3", "version 2"), "GPL-2.0"),
    (_GPL3.replace("General Public", "Lesser General Public").replace("version 3", "version 2.1").replace("Frob", "This library"), "LGPL-2.1"),
    (_GPL_OPENING, "GPL-3.0"),
    ("// SPDX-License-Identifier: MIT\n" + _CODE, "MIT"),
    ("// Copyright 2019 Frob\n// SPDX-License-Identifier: GPL-2.0-or-later\n" + _CODE, "GPL-2.0"),
    ("# SPDX-License-Identifier: BSD-2-Clause", "BSD-2-Clause"),
    ("; SPDX-License-Identifier: LGPL-3.0-only\n(code)", "LGPL-3.0"),
    ("// SPDX-License-Identifier: Frob-1.0", None),
    ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.", "MPL-2.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    ("Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "ISC"),
    ("All rights reserved.", "Proprietary"),
    ("Copyright 2020 Frob. All rights reserved.\n\n" + _MIT, "MIT"),
    (_CODE, None),
    ("Wir sind mit dem Zug gefahren, mit Freunden und mit Hunden.", None),
    ("The license of the driver was renewed by the public office under version three of the form.", None),
    ("You may copy and distribute this recipe freely; the author has no rights reserved in it.", None),
]


def test_real_notices_and_files(spark) -> None:  # noqa: ANN001
    filler = [(f"words{k} of the text and use for a {k} file or software " * 3, None) for k in range(40)]
    rows = [(k, *x) for k, x in enumerate(REAL + filler)]
    got = {r["id"]: r["own_license"] for r in score(spark.createDataFrame(rows, "path long, text string, want string")).collect()}
    wrong = [(got.get(k), want, text[:60]) for k, text, want in rows if got.get(k) != want]
    assert not wrong


def test_scores_and_inheritance(spark) -> None:  # noqa: ANN001
    mit, apache, gpl = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3."
    rows = [("r/LICENSE", mit), ("r/a/x.py", "code only\nmore code"), ("r/b/LICENSE", apache), ("r/b/c/y.py", "first line\n" + gpl + "\nlast line"), ("r/b/c/z.py", ""), ("q/z.py", None), (None, "x"), ("r/a/x.py", "code only\nmore code")]
    df = spark.createDataFrame(rows, "path string, text string")
    found = {r["id"]: (r["own_license"], r["at_edge"]) for r in score(df).collect()}
    assert found == {"r/LICENSE": ("MIT", True), "r/b/LICENSE": ("Apache-2.0", True), "r/b/c/y.py": ("GPL-3.0", False)}
    files = spark.createDataFrame([(p, *(found.get(p) or (None, None))) for p, _ in rows], "path string, own_license string, is_licence boolean")
    got = Counter((r["path"], r["license"], r["inherited_from"]) for r in inherit(files.fillna(False)).collect())
    assert got == Counter([("r/LICENSE", "MIT", None), ("r/a/x.py", "MIT", "r"), ("r/a/x.py", "MIT", "r"), ("r/b/LICENSE", "Apache-2.0", None), ("r/b/c/y.py", "GPL-3.0", None), ("r/b/c/z.py", "Apache-2.0", "r/b"), ("q/z.py", None, None), (None, None, None)])
    assert score(df.limit(0)).count() == 0


def test_only_licence_files_give_to_a_folder(spark) -> None:  # noqa: ANN001
    rows = [(1, "p/a.py", "# SPDX-License-Identifier: MIT\n" + _CODE), (2, "p/b.py", _CODE), (3, "q/COPYING", _GPL_OPENING), (4, "q/s/c.py", _CODE), (4, "q/s/c.py", "Released under the MIT License."), (5, None, _CODE)]
    df = spark.createDataFrame(rows, "doc_id long, file string, text string")
    got = Counter((r["doc_id"], r["path"], r["own_license"], r["license"], r["inherited_from"]) for r in scan(df, path=F.col("file")).collect())
    assert got == Counter([(1, "p/a.py", "MIT", "MIT", None), (2, "p/b.py", None, None, None), (3, "q/COPYING", "GPL-3.0", "GPL-3.0", None), (4, "q/s/c.py", None, "GPL-3.0", "q"), (4, "q/s/c.py", "MIT", "MIT", None), (5, None, None, None, None)])


def test_scan_edges(spark, edges) -> None:  # noqa: ANN001
    got = scan(edges).collect()
    assert len(got) == len(EDGES) and scan(edges.limit(0)).count() == 0
    assert all((r["own_license"], r["license"], r["inherited_from"]) == (None, None, None) for r in got)
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in EDGES)
    # Ties: two templates that fit alike, licence files of one folder, repeated rows and identifiers.
    text = "x\nReleased under the MIT License."
    rows = [(31, text, "s"), (31, text, "s"), (32, "Licensed under CC BY-SA 4.0.", "s"), (33, "none", "s"), (33, None, "s"), (None, text, "s"), (34, "word " * 100_000 + "\n" + text, None)]
    out = Counter((r["doc_id"], r["own_license"], r["license"], r["inherited_from"]) for r in scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    assert out == Counter({(31, "MIT", "MIT", None): 2, (32, "CC-BY-SA-4.0", "CC-BY-SA-4.0", None): 1, (33, None, "MIT", "s/3"): 2, (None, "MIT", "MIT", None): 1, (34, "MIT", "MIT", None): 1})

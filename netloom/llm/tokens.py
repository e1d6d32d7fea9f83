"""Token ids from a byte-level BPE vocabulary of the tokenizers library, fast enough for whole corpora.

The pre-tokenizer of such vocabularies always starts anew at a single space that stands between two characters which are
not white space, so texts can be cut there: the ids of a text are those of its cuts in order. Cuts whose ids are known
from earlier texts are looked up; the others of a group of texts are given to the library joined into one text, whose ids
fall apart again where a token starts with a space. Texts with other white space beside spaces are encoded whole.
"""

from __future__ import annotations

import json
import os
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from netloom.llm.common import worker_cache

#: Cuts kept in a worker, about 200 bytes each, and the longest cut that is kept.
CUTS_KEPT, LONGEST_KEPT = 600_000, 48
#: Characters of the texts that are encoded together.
GROUP_CHARS = 4_000_000
#: White space other than the space.
_OTHER = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]


def _tangled(text: str) -> bool:
    """Where a space stands beside other white space or at an end, it may belong to the cut before it."""
    return "  " in text or text[0].isspace() or text[-1].isspace() or any(c in text and (f"{c} " in text or f" {c}" in text) for c in _OTHER)


class Encoder:
    """Encodes texts with one vocabulary file; one instance for each Python worker and file."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.width = np.dtype("<u2" if size <= 65536 else "<u4")
        #: Whether a token starts with a space, which byte-level vocabularies write as this letter.
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        model = json.loads(self.tokenizer.to_str())
        before = model["pre_tokenizer"] or {}
        #: Other kinds of vocabularies get whole texts.
        self.cuttable = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and model["normalizer"] is None
        special = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content for t in special]
        #: Ids of cuts, by the cut without the space that it starts with.
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        return worker_cache(f"encoder {path}", lambda: cls(path))

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.width) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, in order; a null text has none."""
        group: list[str] = []
        size = 0
        for text in texts:
            group.append(text or "")
            size += len(text or "")
            if size > GROUP_CHARS:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def encode_rows(self, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, np.ndarray]]:
        """(first column, ids of the second column) of each row; groups of texts go across batches."""
        waiting: deque = deque()

        def texts() -> Iterator[str | None]:
            for batch in batches:
                waiting.extend(batch.column(0).to_pylist())
                yield from batch.column(1).to_pylist()

        for ids in self.encode(texts()):
            yield waiting.popleft(), ids

    def _known(self, cuts: list[str]) -> list[bytes]:
        """The ids of distinct cuts, each with a space before it."""
        # What was not used since the cuts were last set aside goes when they are set aside again.
        if len(self.kept) > CUTS_KEPT // 2:
            self.kept, self.older = {}, self.kept
        kept, older = self.kept, self.older
        fresh = []
        for cut in cuts:
            if cut not in kept:
                if cut in older:
                    kept[cut] = older[cut]
                else:
                    fresh.append(cut)
        long = {}
        for at in range(0, len(fresh), 500 * 64):
            some = [fresh[k : k + 500] for k in range(at, min(at + 500 * 64, len(fresh)), 500)]
            for now, ids in zip(some, self._library([" " + " ".join(now) for now in some]), strict=True):
                raw, w = ids.tobytes(), self.width.itemsize
                ends = [*(np.flatnonzero(self.opens[ids]) * w).tolist(), len(raw)]
                for cut, a, b in zip(now, ends[:-1], ends[1:], strict=True):
                    (kept if len(cut) <= LONGEST_KEPT else long)[cut] = raw[a:b]
        return [kept[cut] if cut in kept else long[cut] for cut in cuts]

    def _group(self, group: list[str]) -> Iterator[np.ndarray]:
        whole = [not self.cuttable or not text or _tangled(text) or any(s in text for s in self.special) for text in group]
        cuts = pc.split_pattern(pa.array([text for w, text in zip(whole, group, strict=True) if not w], pa.large_string()), " ")
        begins = cuts.offsets.to_numpy()[:-1]
        coded = cuts.values.dictionary_encode()
        known = self._known(coded.dictionary.to_pylist())
        # The first cut of a text has no space before it; texts that are encoded whole are one cut.
        first = iter(cuts.values.take(pa.array(begins)).to_pylist())
        plain = self._library([text if w else next(first) for w, text in zip(whole, group, strict=True)])
        table = [*known, *(ids.tobytes() for ids in plain)]
        lengths = np.fromiter(map(len, table), np.int64, len(table)) // self.width.itemsize
        starts = np.cumsum(lengths) - lengths
        ids = np.frombuffer(b"".join(table), dtype=self.width)
        which = coded.indices.to_numpy().astype(np.int64)
        which[begins] = len(known) + np.flatnonzero(~np.array(whole, bool))
        n = lengths[which]
        ends = np.cumsum(n)
        at = np.repeat((starts[which] - (ends - n)).astype(np.int32), n)
        at += np.arange(len(at), dtype=np.int32)
        text_ids = ids[at]
        bounds = iter(np.append(ends, 0)[cuts.offsets.to_numpy()[1:] - 1].tolist())
        at = 0
        for w, alone in zip(whole, plain, strict=True):
            if w:
                yield alone
            else:
                yield text_ids[at : (at := next(bounds))]

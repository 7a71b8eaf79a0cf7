"""SentencePiece ids of whole texts and back, by a streaming search over the pieces of a BPE model.

For every position only the last piece of the prefix's segmentation is kept, as a backpointer: of the pieces that end there
it is the one that the model's merges would leave after the last piece at its start (a pair is tried by undoing its two
pieces' own merges, the latest first, and looking for an earlier merge across their border). Backpointers reach back by the longest piece at most, so that window is all that is held. As soon as
all paths that still matter run through one boundary, the ids before it are given out. No piece has the space mark inside,
so paths converge there at the latest, and between two characters that are neighbours in no piece; what lies between is a
unit, and units met before are taken from a store.

Null counts as an empty text, which has no ids. Texts that hold U+2581 decode to a space there, as in the library.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record_batch, ship

#: Units in each of the two generations that a worker keeps; what is used again moves to the younger.
KEEP = 450_000
MARK = "▁"
_UNITS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.raw: list[bytes] = [b""] * n
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.raw[i] = piece.replace(MARK, " ").encode()
                self.ids[piece] = i
                self.score[piece] = sp.get_score(i)
        assert not any(MARK in p.strip(MARK) for p in self.ids)
        self.longest = max(map(len, self.ids))
        self.single = {c for p in self.ids for c in p} & set(self.ids)
        self.pairs: dict[tuple[str, str], bool] = {}
        #: Of each piece made by a merge: the merge's place in order, and the two parts it joins.
        self.order = {p: -s for p, s in self.score.items() if len(p) > 1}
        self.parts: dict[str, tuple[str, str]] = {}
        self.usable = set()
        for p in self.ids:
            parts = self.merged(p, 2)
            if len(p) == 1:
                self.usable.add(p)
            elif p.strip(MARK) and len(parts) == 2 and all(len(x) == 1 or self.order[x] < self.order[p] for x in parts):
                self.usable.add(p)
                self.parts[p] = parts[0], parts[1]
            elif self.merged(p) == [p]:
                self.usable.add(p)
        lengths: dict[str, set[int]] = {}
        for p in self.usable:
            lengths.setdefault(p[-1], set()).add(len(p))
        #: By a piece's last character, its possible lengths, the longest first.
        self.lengths = {c: sorted(x, reverse=True) for c, x in lengths.items()}
        self.neighbours = {p[k : k + 2] for p in self.usable for k in range(len(p) - 1)}
        self.kept: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merged(self, text: str, until: int = 1) -> list[str]:
        """The parts of a short text after applying the best merge, the first of equals, until so few are left."""
        parts = list(text)
        while len(parts) > until:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: str, b: str) -> bool:
        """Whether the merges leave b after a."""
        order, parts = self.order, self.parts
        if len(a) > 1 and a not in parts or len(b) > 1 and b not in parts:
            return self.merged(a + b) == [a, b]
        latest, tie = float("inf"), False
        x, y = a, b
        while True:
            across = order.get(x + y)
            if across is not None and (across < latest or tie and across == latest):
                return False
            px, py = parts.get(x), parts.get(y)
            if px is None and py is None:
                return True
            # of two equal merges the left one comes first
            if py is None or px is not None and order[x] > order[y]:
                latest, tie, x = order[x], False, px[1]
            else:
                latest, tie, y = order[y], True, py[0]

    def segment(self, text: str, commit) -> None:
        """Search text; commit(pieces) is called whenever all surviving paths have converged on one boundary."""
        usable, follows, pairs, lengths, longest, n = self.usable, self.follows, self.pairs, self.lengths, self.longest, len(text)
        if len(pairs) > 400_000:
            pairs.clear()
        base, last = 0, [""]  # last[i - base]: the last piece of the prefix that ends at i
        for i in range(1, n + 1):
            found = None
            for size in lengths[text[i - 1]]:
                j = i - size
                if j < base:
                    continue
                p = text[j:i]
                if p in usable:
                    before = last[j - base]
                    if not before:
                        found = p
                        break
                    ok = pairs.get((before, p))
                    if ok is None:
                        ok = pairs[before, p] = follows(before, p)
                    if ok:
                        found = p
                        break
            last.append(found)
            if i < n and i - base >= 4 * longest:
                # where every path that a later piece can start from has been
                alive = set(range(max(base, i - longest + 1), i + 1))
                while len(alive) > 1:
                    q = max(alive)
                    alive.remove(q)
                    alive.add(q - len(last[q - base]) if last[q - base] else q)
                at = alive.pop()
                if at > base:
                    commit(self._path(last, at - base))
                    last = last[at - base :]
                    base = at
        commit(self._path(last, n - base))

    @staticmethod
    def _path(last: list, i: int) -> list[str]:
        """Back from i to the start of the window; its first entry is the piece that was given out before."""
        out = []
        while i > 0:
            out.append(last[i])
            i -= len(last[i])
        return out[::-1]

    def _unit(self, unit: str) -> bytes:
        """Ids of a unit, cut where no piece can reach across."""
        out: list[bytes] = []
        kept, neighbours, single = self.kept, self.neighbours, self.single
        first, n = 0, len(unit)
        for i in range(1, n + 1):
            if i < n and unit[i - 1 : i + 1] in neighbours:
                continue
            part = unit[first:i]
            first = i
            ids = kept.get(part) if part != unit else None
            if ids is None:
                found: list[int] = []
                if len(part) == 1 and part not in single:
                    found = [self.byte_ids[b] for b in part.encode()]
                else:
                    self.segment(part, lambda pieces: found.extend(map(self.ids.__getitem__, pieces)))
                ids = kept[part] = np.array(found, np.int32).tobytes()
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids as 32-bit integers, without start and end ids."""
        if not text:
            return b""
        text = text.replace(" ", MARK)
        if MARK * 2 not in text and text[0] != MARK and text[-1] != MARK and "\0" not in text:
            units = (MARK + text).replace("\n", "\0\n\0").replace(MARK, "\0" + MARK).split("\0")
        else:
            units = [u for x in re.split("(\n)", MARK + text) for u in _UNITS.findall(x)]
        try:
            return b"".join(map(self.kept.__getitem__, units))
        except KeyError:
            if len(self.kept) > KEEP:
                self.old, self.kept = self.kept, {}
            kept, old = self.kept, self.old
            for u in set(units).difference(kept):
                ids = old.get(u)
                kept[u] = self._unit(u) if ids is None else ids
            return b"".join([kept[u] for u in units])

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; the space that encoding puts first goes."""
        raw = self.raw
        out = b"".join([raw[i] for i in ids.tolist()])
        return (out[1:] if out[:1] == b" " else out).decode(errors="replace")


def codec(path: str) -> Codec:
    """One per worker process."""
    store = sys.__dict__.setdefault("_tessellar_codecs", {})
    if path not in store:
        store[path] = Codec(path)
    return store[path]


_FIELDS = {"n_tokens": pa.int64(), "ids_crc32": pa.int64(), "round_trip": pa.bool_(), "ids": pa.list_(pa.int32()), "decoded": pa.string()}
_TYPES = {"n_tokens": "long", "ids_crc32": "long", "round_trip": "boolean", "ids": "array<int>", "decoded": "string"}


def encoded(docs: DataFrame, model: str | None = None, keep: tuple[str, ...] = (), outputs: tuple[str, ...] = ("n_tokens", "ids_crc32", "round_trip")) -> DataFrame:
    """doc_id, further columns of docs named in keep, and outputs: ids, their number and crc32, the decoded text, and whether that is the text again."""
    ship(docs.sparkSession)
    model = model or default_path()
    rest = [c for c in keep if c not in ("doc_id", *outputs)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"), *rest)
    kinds = dict(rows.dtypes)

    def run(it: Iterator[pa.RecordBatch]):
        c = codec(model)
        for b in it:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = [np.frombuffer(c.encode(t), np.int32) for t in texts]
                made = {"n_tokens": [len(x) for x in ids], "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids]}
                if "round_trip" in outputs or "decoded" in outputs:
                    made["decoded"] = [c.decode(x) for x in ids]
                    made["round_trip"] = [a == t.replace(MARK, " ") for a, t in zip(made["decoded"], texts)]
                if "ids" in outputs:
                    off = np.concatenate([[0], np.cumsum(made["n_tokens"])]).astype(np.int32)
                    made["ids"] = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
                columns = [part.column(0), *(part.column(2 + k) for k in range(len(rest))), *(made[o] if isinstance(made[o], pa.Array) else pa.array(made[o], _FIELDS[o]) for o in outputs)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *rest, *outputs])

    schema = ", ".join(["doc_id long", *(f"`{c}` {kinds[c]}" for c in rest), *(f"{o} {_TYPES[o]}" for o in outputs)])
    return rows.mapInArrow(run, schema)

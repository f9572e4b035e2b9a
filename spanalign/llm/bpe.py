"""BPE encoding and decoding by tree concatenation.

A text over a leaf's size is encoded by halves, and each join is repaired by encoding a growing
window around it until the window's first and last token equal what both halves had there. Halves are
cut near the middle, between characters that no later cut by classes depends on. A leaf is cut before
spaces that a visible character follows, where no token can lie across; its parts are encoded once
per worker and remembered. Documents longer than a segment are dealt over the cluster by segments and
joined pairwise in the same way.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from array import array
from bisect import bisect_right
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanalign.llm.common import table, worker_cache

SEGMENT = 1 << 19
#: Characters that are encoded without a cut in the middle.
LEAF = 4096
REMEMBERED = 200_000

# Fixed value: the pre-tokenizer's pattern of byte-level BPE vocabularies, used for Latin text only.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ODD_SPACE = re.compile(r" (?:\s|$)")
_CUT = re.compile(r" (?=\S)")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class _Memo(dict):
    """Remembers what make() gave: the last REMEMBERED keys or more, as two generations."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key):
        if len(key) > 64:
            return self.make(key)
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


def _kind(ch: str) -> str:
    return unicodedata.category(ch)[0]


class Codec:
    """Encodes and decodes whole texts as the vocabulary file says; ids are little-endian uint32 bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        added = self.tok.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        self.ids = {t.content: np.array([i], "<u4").tobytes() for i, t in added.items()}
        # added tokens that take nothing from around them cut a text into parts that are encoded by themselves
        plain = all(not (t.lstrip or t.rstrip or t.single_word or t.normalized) for t in added.values())
        self.specials = re.compile("|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True))) if plain and self.special else None
        back = {s: b for b, s in byte_symbols().items()}
        self.bytes_of = {}
        for token, i in self.tok.get_vocab(with_added_tokens=True).items():
            known = all(c in back for c in token)
            self.bytes_of[i] = bytes(back[c] for c in token) if known else token.encode()
        self.ranked = self._ranked(path)
        self.spaced = _Memo(lambda part: self._part(" " + part))

    def _ranked(self, path: str):
        """An encoder of short Latin parts by token ranks, if the merges' order is that of the ids."""
        import json

        import tiktoken

        model = json.loads(Path(path).read_text())["model"]
        made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if made != sorted(made) or model.get("dropout") or model.get("ignore_merges"):
            return None
        special = set(self.special)
        ranks = {self.bytes_of[i]: i for t, i in model["vocab"].items() if t not in special}
        return tiktoken.Encoding("ranked", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        if part and self.ranked and (part.isascii() or max(part) < "ɐ"):
            return array("I", self.ranked.encode_ordinary(part)).tobytes()
        return self._plain(part)

    def encode(self, text: str) -> bytes:
        if not any(x in text for x in self.special):
            return self.concatenated(text)
        if self.specials is None:
            return self._plain(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [self.concatenated(text[at : m.start()]), self.ids[m[0]]]
            at = m.end()
        return b"".join([*out, self.concatenated(text[at:])])

    def _leaf(self, text: str) -> bytes:
        if not text:
            return b""
        first, *rest = _CUT.split(text) if _ODD_SPACE.search(text) else text.split(" ")
        return self._part(first) + b"".join(map(self.spaced.__getitem__, rest))

    def cut_near(self, text: str, middle: int, reach: int) -> int | None:
        """The place nearest to ``middle`` where text may be cut, if only tokens can lie across it."""
        for step in range(reach):
            for at in (middle - step, middle + step):
                if 0 < at < len(text):
                    a, b = _kind(text[at - 1]), _kind(text[at])
                    if text[at] == " " and a in "LNPS" and at + 1 < len(text) and _kind(text[at + 1]) in "LNPS":
                        return at
                    if a == b and a in "LN" or {a, b} == {"L", "N"}:
                        return at
                    if a in "PS" and b in "PS" and text[at] != "'" and text[at - 1] != "'":
                        return at
        return None

    def concatenated(self, text: str) -> bytes:
        """The encoding of a text without added tokens: halves first, then their join."""
        if len(text) <= LEAF:
            return self._leaf(text)
        at = self.cut_near(text, len(text) // 2, len(text) // 4)
        if at is None:
            return self._leaf(text)
        return self.join(self.concatenated(text[:at]), self.concatenated(text[at:]))

    def join(self, left: bytes, right: bytes) -> bytes:
        """Encoding of the joined text from the encodings of both sides.

        Every neighbouring pair of an encoding's tokens is itself stable, so the whole is right as
        soon as the window starts with the left side's token there and ends with the right side's.
        """
        a, b = np.frombuffer(left, "<u4"), np.frombuffer(right, "<u4")
        if not len(a) or not len(b):
            return left + right
        width = 8
        while True:
            na, nb = min(width, len(a)), min(width, len(b))
            window = b"".join(self.bytes_of[i] for i in [*a[len(a) - na :].tolist(), *b[:nb].tolist()])
            try:
                made = np.frombuffer(self._plain(window.decode()), "<u4")
            except UnicodeDecodeError:
                made = None  # the window cuts a character
            whole = na == len(a) and nb == len(b)
            starts = made is not None and (na == len(a) or len(made) and made[0] == a[len(a) - na])
            ends = made is not None and (nb == len(b) or len(made) and made[-1] == b[nb - 1])
            if whole or starts and ends and len(made) > 1:
                return a[: len(a) - na].tobytes() + made.tobytes() + b[nb:].tobytes()
            width *= 2

    def inside(self, text: str) -> list[tuple[int, int]] | None:
        """Spans that no cut may part: the added tokens; None if the text has one that takes from around it."""
        if not any(x in text for x in self.special):
            return []
        return None if self.specials is None else [m.span() for m in self.specials.finditer(text)]

    def decode(self, ids: bytes) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    cache = worker_cache()
    if ("codec", path) not in cache:
        cache["codec", path] = Codec(path)
    return cache["codec", path]


#: What a row of encode() can carry: Arrow type, SQL type and how it is made from the ids.
OUTPUTS = {
    "ids": (pa.list_(pa.int32()), "array<int>", lambda c, b, t: np.frombuffer(b, "<i4")),
    "n_tokens": (pa.int64(), "bigint", lambda c, b, t: len(b) // 4),
    "decoded": (pa.string(), "string", lambda c, b, t: c.decode(b)),
    "ids_sha256": (pa.string(), "string", lambda c, b, t: hashlib.sha256(b).hexdigest()),
    "ids_crc32": (pa.int64(), "bigint", lambda c, b, t: zlib.crc32(b)),
    "decoded_sha256": (pa.string(), "string", lambda c, b, t: hashlib.sha256(c.decode(b).encode()).hexdigest()),
}


def encode(docs: DataFrame, tokenizer: str, *, text: str = "text", keys=("doc_id",), outputs=("ids",), segment: int = SEGMENT) -> DataFrame:
    """``keys`` of every row with the chosen OUTPUTS of its whole text.

    Null text counts as empty and gives no ids; repeated rows are encoded each; other columns are
    left out, so their names can't clash; no documents: no rows. Texts over ``segment`` characters are dealt by segments.
    """
    src = docs.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.coalesce(F.col(text), F.lit("")).alias("t"))
    fields = src.schema.fields[:-1]
    kind = ", ".join(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(fields))
    out = f"{kind}, " + ", ".join(f"`{o}` {OUTPUTS[o][1]}" for o in outputs)

    def finish(code, keyed, ids, schema):
        columns = [*keyed]
        for o in outputs:
            columns.append(pa.array([OUTPUTS[o][2](code, b, None) for b in ids], OUTPUTS[o][0]))
        return pa.RecordBatch.from_arrays(columns, names=schema)

    names = [*(f"k{i}" for i in range(len(fields))), *outputs]

    def short(batches):
        code = codec(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [code.encode(t) for t in part.column(len(fields)).to_pylist()]
                yield finish(code, part.columns[:-1], ids, names)

    def segments(batches):
        from pyspark import TaskContext

        code, row = codec(tokenizer), 0
        task = TaskContext.get().partitionId()
        for batch in batches:
            for r in range(batch.num_rows):
                one = batch.slice(r, 1)
                t = one.column(len(fields))[0].as_py()
                cuts, at = [0], segment
                inside = code.inside(t)
                while at < len(t) and inside is not None:
                    cut = code.cut_near(t, at, segment // 4)
                    if cut:
                        k = bisect_right(inside, (cut, len(t))) - 1
                        cut = inside[k][0] if k >= 0 and inside[k][1] > cut else cut
                        cuts += [cut] if cut > cuts[-1] else []
                    at = max(at, cuts[-1]) + segment
                cuts.append(len(t))
                uid = f"{task}-{row}"
                row += 1
                for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    yield pa.RecordBatch.from_arrays([*one.columns[:-1], pa.array([uid]), pa.array([n], pa.int32()), pa.array([t[a:b]])], names=[*names[: len(fields)], "uid", "seg", "t"])

    def encoded(batches):
        code = codec(tokenizer)
        for batch in batches:
            ids = pa.array([code.encode(t) for t in batch.column("t").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=[*batch.schema.names[:-1], "b"])

    def joined(group: pa.Table) -> pa.Table:
        code = codec(tokenizer)
        group = group.sort_by("seg")
        parts = group.column("b").to_pylist()
        while len(parts) > 1:
            parts = [code.join(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        one = group.slice(0, 1).combine_chunks().to_batches()[0]
        return pa.Table.from_batches([finish(code, one.columns[: len(fields)], parts, names)])

    is_long = F.length("t") > segment
    seg_schema = f"{kind}, uid string, seg int"
    long = (
        src.where(is_long).mapInArrow(segments, f"{seg_schema}, t string")
        .repartition("uid", "seg").mapInArrow(encoded, f"{seg_schema}, b binary")
        .groupBy("uid").applyInArrow(joined, out)
    )
    both = src.where(~is_long).mapInArrow(short, out).unionAll(long)
    return both.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keys)), *outputs)


def decode(rows: DataFrame, tokenizer: str, *, ids: str = "ids", into: str = "text") -> DataFrame:
    """``rows`` with the text of each row's ids in ``into``; null ids give a null text."""
    schema = rows.drop(into).schema.add(into, "string")

    def run(batches):
        code = codec(tokenizer)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            texts = [None if x is None else code.decode(np.array(x, "<u4").tobytes()) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, into])

    return rows.drop(into).mapInArrow(run, schema)


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return encode(table(spark, sf_dir, "documents"), path, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))

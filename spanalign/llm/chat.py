"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered as one string and encoded once with offsets. The turns' text spans and
the tokens' spans are both sorted, so each turn's tokens are found by binary search; a token counts
for the loss with the part of it that lies in an assistant's text.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanalign.llm.common import table, worker_cache

# The template's control strings. None begins with what another one, or it, ends with.
START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
#: Characters from which on a conversation is encoded by parts, each of whole turns.
PART = 1 << 20

_INSIDE = re.compile(r"<(\\*)(\|im_start\|>|\|im_end\|>)")
_ESCAPED = re.compile(r"<\\(\\*)(\|im_start\|>|\|im_end\|>)")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)


def escape(text: str) -> str:
    """Puts one backslash more behind the first character of every control string."""
    return _INSIDE.sub(lambda m: "<\\" + m[1] + m[2], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "<" + m[1] + m[2], text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, bool]]]:
    """The string of (role, text) turns and each text's span in it, with whether it is for the loss."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        spans.append((at + len(head), at + len(head) + len(body), role == LOSS_ROLE))
        out += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that render() was given."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def masked(offsets: np.ndarray, spans: list[tuple[int, int, bool]]) -> np.ndarray:
    """For every token (start, end) the part [from, to) of it that is for the loss; from = to: none.

    Only a first and last token of a span can lie over its edge; several tokens may share the
    characters of one code point.
    """
    start, end = offsets[:, 0], offsets[:, 1]
    part = np.zeros_like(offsets)
    for a, b, loss in spans:
        if loss and a < b:
            lo, hi = np.searchsorted(end, a, "right"), np.searchsorted(start, b, "left")
            part[lo:hi, 0] = np.maximum(start[lo:hi], a)
            part[lo:hi, 1] = np.minimum(end[lo:hi], b)
    return part


def loss_text(formatted: str, part: np.ndarray) -> list[str]:
    """The runs of text under the mask, each character once, still escaped."""
    some = part[part[:, 0] < part[:, 1]]
    runs, at = [], -1
    for a, b in some.tolist():
        if a > at or not runs:
            runs.append([a, b])
        else:
            runs[-1][1] = max(runs[-1][1], b)
        at = runs[-1][1]
    return [formatted[a:b] for a, b in runs]


def _encoder(path: str):
    from tokenizers import Tokenizer

    cache = worker_cache()
    if ("chat", path) not in cache:
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        tok.encode_special_tokens = True
        cache["chat", path] = tok
    return cache["chat", path]


#: What a conversation's rows can carry.
OUTPUTS = {
    "formatted": ("string", pa.string()),
    "ids": ("array<int>", pa.list_(pa.int32())),
    "loss_from": ("array<int>", pa.list_(pa.int32())),
    "loss_to": ("array<int>", pa.list_(pa.int32())),
    "n_turns": ("bigint", pa.int64()),
    "turns_sha256": ("string", pa.string()),
    "loss_chars": ("bigint", pa.int64()),
    "loss_sha256": ("string", pa.string()),
    "formatted_chars": ("bigint", pa.int64()),
    "n_tokens": ("bigint", pa.int64()),
}
DIGESTS = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens")


def chats(turns: DataFrame, tokenizer: str, *, outputs=DIGESTS) -> DataFrame:
    """A row for each conversation of ``turns`` (conv_id, turn, role, text), formatted and read back.

    Turns go by turn (null first), then role and text; equal rows are turns each. Null texts and
    roles are empty; a null conv_id is a conversation. Other columns are ignored. No rows: none.
    Partitions are sorted and streamed, and a long conversation is encoded in parts of whole turns,
    so a task holds one part; only ``formatted`` and ``ids``, if asked for, hold a conversation.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = "conv_id bigint, " + ", ".join(f"{o} {OUTPUTS[o][0]}" for o in outputs)
    long_ones = {"formatted", "ids", "loss_from", "loss_to"} & set(outputs)

    def run(batches):
        tok = _encoder(tokenizer)

        class Conversation:
            def __init__(self, conv):
                self.conv, self.turns, self.size = conv, [], 0
                self.said, self.loss = hashlib.sha256(), hashlib.sha256()
                self.out = dict.fromkeys(("n_turns", "loss_chars", "formatted_chars", "n_tokens"), 0)
                self.parts = {o: [] for o in long_ones}

            def add(self, role, text):
                self.turns.append((role, text))
                self.size += len(text)
                if self.size > PART:
                    self.encode()

            def encode(self):
                if not self.turns:
                    return
                formatted, spans = render(self.turns)
                made = tok.encode(formatted, add_special_tokens=False)
                part = masked(np.array(made.offsets, np.int64).reshape(-1, 2), spans)
                texts = [unescape(t) for t in loss_text(formatted, part)]
                read = parse(formatted)
                self.said.update("".join(f"{r}\n{t}\n" for r, t in read).encode())
                self.loss.update("".join(texts).encode())
                for k, v in (("n_turns", len(read)), ("loss_chars", sum(map(len, texts))), ("formatted_chars", len(formatted)), ("n_tokens", len(made.ids))):
                    self.out[k] += v
                base = self.out["formatted_chars"] - len(formatted)
                for o, v in (("formatted", [formatted]), ("ids", made.ids), ("loss_from", (part[:, 0] + base).tolist()), ("loss_to", (part[:, 1] + base).tolist())):
                    if o in long_ones:
                        self.parts[o] += v
                self.turns, self.size = [], 0

            def row(self):
                self.encode()
                whole = {o: "".join(v) if o == "formatted" else v for o, v in self.parts.items()}
                return (self.conv, *({**self.out, **whole, "turns_sha256": self.said.hexdigest(), "loss_sha256": self.loss.hexdigest()}[o] for o in outputs))

        def batch_of(done):
            cols = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), *(OUTPUTS[o][1] for o in outputs)], strict=True)], names=["conv_id", *outputs])

        now, done = None, []
        for batch in batches:
            for conv, _, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    now = Conversation(conv)
                now.add(role, text)
                if len(done) >= 500:
                    yield batch_of(done)
                    done = []
        if now is not None:
            done.append(now.row())
        if done:
            yield batch_of(done)

    return rows.mapInArrow(run, schema)


def op6_chat(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    hard = f"SELECT * FROM VALUES (-1L, 0L, 'user', '{'</s>[INST] ok [/INST]'}'), (-1L, 1L, 'assistant', '{'</s>[INST] ok [/INST]'}') AS t(conv_id, turn, role, text)"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(hard))
    out = chats(turns, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


ORACLE = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_replace(text, '<(\\\\*)(\\|im_start\\|>|\\|im_end\\|>)', '<\\\\\\1\\2', 'g') AS body FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(role) + 1 + length(body) + 11)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

"""Conversations as training text with a token-level loss mask.

A conversation is rendered whole, encoded once with offsets, and the mask comes from the sorted spans of assistant texts and
the token spans by binary search. The marks are tokens of their own, so no token reaches across the border of a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobmetrics.llm.batches import arrow_map, arrow_schema, to_batch

START, BODY, END = "<|start|>", "<|text|>", "<|end|>"
LEARNED = "assistant"
#: A segment ends with the turn that brings it to so many characters.
SEGMENT_CHARS = 1 << 18
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(BODY) + "(.*?)" + re.escape(END), re.S)


def escape(text: str) -> str:
    """Keeps the opening of a mark out of a text; ``unescape`` gives the text back."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The text of (role, text) turns, and start and end of each assistant text in it, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{BODY}", escape(text)
        if role == LEARNED and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a rendered text."""
    return [(unescape(role), unescape(body)) for role, body in _TURN.findall(text)]


def mask(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which tokens meet one of the sorted, separate spans: the first span that ends after the token's start must begin before its end."""
    if not len(spans):
        return np.zeros(len(starts), bool)
    k = np.searchsorted(spans[:, 1], starts, side="right")
    found = np.minimum(k, len(spans) - 1)
    return (k < len(spans)) & (spans[found, 0] < ends) & (ends > starts)


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer of the file with the marks as special tokens, giving offsets of whole tokens, spaces included."""
    from tokenizers import Tokenizer, processors

    t = Tokenizer.from_file(path)
    t.post_processor = processors.ByteLevel(trim_offsets=False)
    t.add_special_tokens([START, BODY, END])
    return t


def encode(text: str, path: str) -> tuple[list[int], np.ndarray, np.ndarray]:
    e = tokenizer(path).encode(text, add_special_tokens=False)
    offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
    return e.ids, offsets[:, 0], offsets[:, 1]


def under_mask(text: str, starts: list[int], ends: list[int], loss: list[bool]) -> str:
    """The text that the masked tokens cover, each character once, unescaped."""
    out, done = [], 0
    for s, e, on in zip(starts, ends, loss):
        if on and e > done:
            out.append(text[max(s, done) : e])
            done = e
    return unescape("".join(out))


SEGMENT = (
    "conv_id long, segment long, n_turns long, text string, ids array<int>, token_starts array<int>, token_ends array<int>, loss array<boolean>"
)


def format_conversations(turns: DataFrame, tokenizer_file: str, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Segments of formatted conversations: text, ids, token spans in code points and the loss mask of each token.

    ``turns`` has conv_id, turn, role and text; other columns are left out. A conversation is one segment, or several
    if it is long; since marks are tokens of their own, its ids are those of the whole text. Its segments follow each other in one
    partition. Turns go by number, then role, then text, nulls first; repeated rows are turns of their own. A null text
    or role is empty; rows with a null conv_id are one conversation. An empty table gives an empty one.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    target = arrow_schema(SEGMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, segment, pending, size = None, 0, [], 0

        def done() -> pa.RecordBatch:
            text, spans = render(pending)
            ids, starts, ends = encode(text, tokenizer_file)
            loss = mask(spans, starts, ends)
            return to_batch([(current[0], segment, len(pending), text, ids, starts.tolist(), ends.tolist(), loss.tolist())], target)

        for batch in batches:
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                if current != (conv,):
                    if pending:
                        yield done()
                    current, segment, pending, size = (conv,), 0, [], 0
                elif size >= segment_chars:
                    yield done()
                    segment, pending, size = segment + 1, [], 0
                pending.append((role, text))
                size += len(text) + len(role)
        if pending:
            yield done()

    return arrow_map(ordered, run, SEGMENT)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def conversation_digests(segments: DataFrame) -> DataFrame:
    """Turns, text under the loss mask and length of each conversation, read back from the output of ``format_conversations``."""
    target = arrow_schema(DIGEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = turns = loss = None
        counts = [0, 0, 0]

        def done() -> pa.RecordBatch:
            return to_batch([(current[0], counts[0], turns.hexdigest(), counts[1], loss.hexdigest(), counts[2])], target)

        for batch in batches:
            for row in batch.to_pylist():
                if current != (row["conv_id"],):
                    if current:
                        yield done()
                    current, turns, loss, counts = (row["conv_id"],), sha256(), sha256(), [0, 0, 0]
                read = parse(row["text"])
                for role, text in read:
                    turns.update(f"{role}\n{text}\n".encode())
                learned = under_mask(row["text"], row["token_starts"], row["token_ends"], row["loss"])
                loss.update(learned.encode())
                counts = [counts[0] + len(read), counts[1] + len(learned), counts[2] + len(row["text"])]
        if current:
            yield done()

    return arrow_map(segments, run, DIGEST)

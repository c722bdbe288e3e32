"""Chat formatting with loss masks aligned to offsets.

A conversation is rendered as ``<|turn|>role<|says|>text<|end|>`` for each turn. The marks are special tokens, added to a byte-level
tokenizer, so no token reaches over one; inside roles and texts ``<|`` is written ``<\\|``, and what looks like that gets
one more backslash. The rendered conversation is encoded once with offsets; the spans of assistant texts,
in order, are cut with the spans of the tokens, in order, by binary search.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer

from penprint.llm.common import new_path, partitions, small_batches

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
MARKS = (TURN, SAYS, END)
PART_TURNS = 64  # turn numbers per rendered row: a conversation without end still gives rows of bounded size
FORMATTED = (
    "conv_id long, part long, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"
)


def escape(text: str) -> str:
    """Text in which no mark can occur: one more backslash in every ``<``, backslashes, ``|``."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The rendered turns and the spans of the texts to learn, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{SAYS}", escape(text)
        at += len(head)
        if role == learn:
            spans.append((at, at + len(body)))
        at += len(body) + len(END)
        parts += [head, body, END]
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    turns = []
    for piece in formatted.split(TURN)[1:]:
        role, _, text = piece.partition(SAYS)
        turns.append((unescape(role), unescape(text.removesuffix(END))))
    return turns


@lru_cache(maxsize=2)
def chat_tokenizer(path: str) -> Tokenizer:
    """A byte-level tokenizer with the marks as special tokens."""
    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in MARKS])
    return tokenizer


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Tokens inside the spans. Both lists rise, so each span is a range of tokens between two binary searches."""
    mask = np.zeros(len(starts), bool)
    if spans:
        bounds = np.array(spans)
        first = np.searchsorted(ends, bounds[:, 0], side="right")
        last = np.searchsorted(starts, bounds[:, 1], side="left")
        for a, b in zip(first.tolist(), last.tolist()):
            mask[a:b] = True
    return mask


def masked_texts(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """The texts under the mask, one for each run of tokens, unescaped."""
    edges = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return [unescape(formatted[starts[a]:ends[b - 1]]) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]


def format_chats(
    turns: DataFrame, tokenizer: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant"
) -> DataFrame:
    """One row per conversation and ``PART_TURNS`` turn numbers: rendered text, ids, offsets and loss mask.

    Turns come in the order of ``turn``, nulls first, ties by role and text. Null roles and texts count as empty; a null conversation id
    is a conversation of its own; repeated rows are turns of their own. Parts of a conversation, one after the other, are
    the rendering and the encoding of the whole, since marks end every turn. Other columns are not carried.
    """
    rows = turns.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.floor(F.col(turn) / PART_TURNS).cast("long").alias("part"), F.col(turn).alias("turn"),
        F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = chat_tokenizer(tokenizer)
        key: tuple | None = None
        held: list[tuple[str, str]] = []

        def finish() -> pa.RecordBatch:
            formatted, spans = render(held, learn)
            encoding = model.encode(formatted, add_special_tokens=False)
            offsets = np.array(encoding.offsets, np.int32).reshape(-1, 2)
            mask = loss_mask(offsets[:, 0], offsets[:, 1], spans)
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([formatted]), pa.array([encoding.ids], pa.list_(pa.int32())),
                 pa.array([offsets[:, 0]], pa.list_(pa.int32())), pa.array([offsets[:, 1]], pa.list_(pa.int32())), pa.array([mask], pa.list_(pa.bool_()))],
                names=["conv_id", "part", "formatted", "ids", "starts", "ends", "loss"])

        for batch in small_batches(batches):
            for *here, who, said in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "role", "text"))):
                if held and tuple(here) != key:
                    yield finish()
                    held = []
                key = tuple(here)
                held.append((who, said))
        if held:
            yield finish()

    dealt = rows.repartition(partitions(turns.sparkSession), "conv_id", "part").sortWithinPartitions("conv_id", "part", "turn", "role", "text")
    return dealt.mapInArrow(encode, FORMATTED)


def write_chats(formatted: DataFrame, path: str | None = None) -> DataFrame:
    """Write formatted conversations as Parquet and read them back."""
    spark = formatted.sparkSession
    path = path or new_path(spark, "chats")
    formatted.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(formatted.schema).parquet(path)


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted rows hold, per conversation: turns, texts under the mask, and their digests.

    Parts of a conversation stream through one task in order; no task holds a conversation.
    """
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        name: int | None = None
        state: list | None = None

        def close() -> None:
            turns, words, loss = state[1], state[3], state[0]
            out.append((name, state[2], turns.hexdigest(), state[4], loss.hexdigest(), words))

        for batch in small_batches(batches):
            for conv, text, starts, ends, mask in zip(*(batch.column(c) for c in ("conv_id", "formatted", "starts", "ends", "loss"))):
                conv, text = conv.as_py(), text.as_py()
                if state is None or conv != name:
                    if state is not None:
                        close()
                    name, state = conv, [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
                for role, said in parse(text):
                    state[1].update(f"{role}\n{said}\n".encode())
                    state[2] += 1
                starts, ends, mask = (x.values.to_numpy(zero_copy_only=False) for x in (starts, ends, mask))
                for said in masked_texts(text, starts, ends, mask.astype(bool)):
                    state[0].update(said.encode())
                    state[4] += len(said)
                state[3] += len(text)
            if len(out) >= 1000:
                yield _rows(out)
                out = []
        if state is not None:
            close()
        yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=list(names))

    dealt = formatted.select("conv_id", "part", "formatted", "starts", "ends", "loss").repartition(partitions(formatted.sparkSession), "conv_id")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return dealt.sortWithinPartitions("conv_id", "part").mapInArrow(digest, schema)

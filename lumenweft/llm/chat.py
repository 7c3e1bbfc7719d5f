"""Chat formatting by incremental black-box rendering.

A template is any function from turns to text. Rendering the prefixes of a conversation one turn longer each time and
comparing consecutive outputs locates the span of each turn; an output that does not begin with the one before shows a
template that rewrites history. Where the content lies within a span is found by rendering two probe texts in its place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenweft.session import ship

Turn = tuple[str, str]
END = "</turn>"


def escape(text: str) -> str:
    """Backslashes doubled, one put before each control string: a text never closes or opens a turn."""
    return text.replace("\\", "\\\\").replace("###", "\\###").replace(END, "\\" + END)


def unescape(text: str) -> str:
    parts = text.split("\\")
    out, k = [parts[0]], 1
    while k < len(parts):
        if parts[k] == "" and k + 1 < len(parts):  # a doubled backslash
            out.append("\\" + parts[k + 1])
            k += 2
        else:
            out.append(parts[k])
            k += 1
    return "".join(out)


def escape_role(role: str) -> str:
    return escape(role).replace(":", "\\:")


def render(turns: list[Turn]) -> str:
    """The default template: ``### Role: text </turn>`` a line, with reversible escapes.

    A role that begins with a-z is written with a capital, any other after an equals sign.
    """

    def header(role: str) -> str:
        return escape_role(role[0].upper() + role[1:] if "a" <= role[:1] <= "z" else "=" + role)

    return "".join(f"### {header(role)}: {escape(text)} {END}\n" for role, text in turns)


def _closing(text: str, mark: str, start: int) -> int:
    """Where ``mark`` next stands with an even number of backslashes before it."""
    while True:
        at = text.index(mark, start)
        back = at
        while back > 0 and text[back - 1] == "\\":
            back -= 1
        if (at - back) % 2 == 0:
            return at
        start = at + 1


def parse(formatted: str) -> list[Turn]:
    """The turns of a conversation in the default template: the inverse of ``render``."""
    turns, at = [], 0
    while at < len(formatted):
        colon = _closing(formatted, ":", at + 4)
        role = unescape(formatted[at + 4 : colon])
        end = _closing(formatted, END, colon + 2)
        turns.append((role[1:] if role.startswith("=") else role[:1].lower() + role[1:], unescape(formatted[colon + 2 : end - 1])))
        at = end + len(END) + 1
    return turns


def locate(turns: list[Turn], template: Callable[[list[Turn]], str]) -> tuple[str, list[tuple[int, int, int, int]], list[int]]:
    """The rendered conversation; (start, end, content start, content end) of each turn; turns that rewrite history.

    After a rewrite a turn's span is what follows the common prefix with the output before.
    """
    spans, rewrites, before = [], [], template([])
    for k in range(1, len(turns) + 1):
        now = template(turns[:k])
        start = len(before)
        if not now.startswith(before):
            rewrites.append(k - 1)
            start = next((i for i, (x, y) in enumerate(zip(before, now, strict=False)) if x != y), min(len(before), len(now)))
        role = turns[k - 1][0]
        a, b = (template([*turns[: k - 1], (role, probe)]) for probe in ("a", "b"))
        at = next((i for i, (x, y) in enumerate(zip(a[start:], b[start:], strict=True), start) if x != y), start)
        spans.append((start, len(now), at, at + len(now) - len(a) + 1))
        before = now
    return before, spans, rewrites


FORMATTED = "conv_id long, formatted string, loss array<struct<start: long, end: long>>, turns array<struct<start: long, end: long>>, rewrites array<long>"


def _formatter(template: Callable[[list[Turn]], str], learn: str, schema: pa.Schema):
    """Rows sorted by conversation; one conversation is held at a time."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        conv, turns = None, []

        def finish() -> dict:
            text, spans, rewrites = locate(turns, template)
            loss = [{"start": s[2], "end": s[3]} for s, (role, _) in zip(spans, turns, strict=True) if role == learn]
            return {"conv_id": conv, "formatted": text, "loss": loss, "turns": [{"start": s[0], "end": s[1]} for s in spans], "rewrites": rewrites}

        for batch in batches:
            for key, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if turns and (key != conv or key is None):
                    yield finish()
                    turns = []
                conv = key
                turns.append((role or "", text or ""))
        if turns:
            yield finish()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for row in rows(batches):
            held.append(row)
            if len(held) >= 500:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held = []
        yield pa.RecordBatch.from_pylist(held, schema=schema)

    return run


def format_chats(conversations: DataFrame, template: Callable[[list[Turn]], str] = render, learn: str = "assistant") -> DataFrame:
    """One row a conversation: text, loss mask over the turns of role ``learn``, turn spans, turns that rewrite history.

    ``conversations`` has conv_id, turn, role, text; turns are taken in order, ties by role and text, null turns first.
    Null roles and texts count as empty; a row without conv_id is a conversation of its own. Repeated rows are turns of
    their own. conv_id is a whole number (or text that is one; other text fails the query). An empty table gives an empty
    result; more columns are ignored. All offsets are in code points. The rows of a conversation meet in one task, which holds
    one conversation at a time; rendering every prefix of it takes time with the square of its turns.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(conversations.sparkSession)
    read = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    own = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")).otherwise(0)
    dealt = read.repartition("conv_id", own).sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return dealt.mapInArrow(_formatter(template, learn, to_arrow_schema(StructType.fromDDL(FORMATTED))), FORMATTED)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def digest(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            text = row["formatted"]
            turns = parse(text)
            learned = "".join(unescape(text[s["start"] : s["end"]]) for s in row["loss"])
            out.append([row["conv_id"], len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), digest(learned), len(text), len(row["rewrites"])])
        columns = list(zip(*out, strict=True)) or [[] for _ in range(7)]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in READ.split(", ")])


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests of conversations in the default template, parsed back from their text and loss mask."""
    ship(formatted.sparkSession)
    return formatted.mapInArrow(_read_back, READ)


#: A conversation whose texts hold every control string.
TRICKY = "\\### Assistant: </turn> ok"


def op4(conversations: DataFrame) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    spark = conversations.sparkSession
    read = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(read.unionByName(extra)))

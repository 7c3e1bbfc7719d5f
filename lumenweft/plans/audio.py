"""Speech from texts and texts from speech. The engines are functions from text to bytes and back, given by the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, DataType, StringType, StructField, StructType

from lumenweft.functions import text as T
from lumenweft.session import ship

#: Bytes of a recording at most.
MOST_RECORDING = 25 << 20


def _with(df: DataFrame, column: str, name: str, kind: DataType, answer: Callable[[object], object]) -> DataFrame:
    """``df`` with ``answer`` of a column as ``name``, and the reason in ``error`` where there is none."""
    ship(df.sparkSession)
    place = df.columns.index(column)
    schema, arrow = StructType([*df.schema.fields, StructField(name, kind), StructField("error", StringType())]), to_arrow_type(kind)

    def one(value: object) -> tuple[object, str | None]:
        try:
            return answer(value), None
        except Exception as why:  # noqa: BLE001  the engine's fault, kept with the row
            return None, f"{type(why).__name__}: {why}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [one(v) for v in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([p[0] for p in pairs], arrow), pa.array([p[1] for p in pairs], pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def speak(stories: DataFrame, engine: Callable[[str], bytes], most: int = 3500) -> DataFrame:
    """``stories`` (title, summary) with ``script``, ``audio`` and ``error``. Without anything to read, or without sound from
    the engine, there is no audio but an error."""

    def sound(script: object) -> bytes:
        if not script:
            raise ValueError("There is no summary to read.")
        audio = engine(script)
        if not isinstance(audio, (bytes, bytearray)) or not audio:
            raise ValueError("The engine returned no sound.")
        return bytes(audio)

    return _with(stories.withColumn("script", T.speech(F.col("title"), F.col("summary"), most)), "script", "audio", BinaryType(), sound)


def transcribe(recordings: DataFrame, engine: Callable[[bytes], str], most: int = MOST_RECORDING) -> DataFrame:
    """``recordings`` (audio) with ``transcript`` and ``error``. Empty and too large recordings never reach the engine."""

    def words(audio: object) -> str:
        if not audio:
            raise ValueError("The recording is empty.")
        if len(audio) > most:
            raise ValueError("The recording is too large.")
        text = " ".join(engine(bytes(audio)).split())
        if not text:
            raise ValueError("There is no speech in the recording.")
        return text

    return _with(recordings, "audio", "transcript", StringType(), words)

"""The line protocol as DataFrame and stream operators.

Lines of no session are answered one by one; with sessions, the handshake is kept as state per session.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..kernel.messages import MAX_BYTES, TOOLS, Session, handle_line

__all__ = ["TOOLS", "replies", "session_replies"]


def replies(lines: DataFrame, key: str, line: str, limit: int = MAX_BYTES) -> DataFrame:
    """(key, reply) of every line that is owed one; works on batches and streams alike."""
    rows = lines.select(F.col(key).alias("key"), F.col(line).alias("line"))

    def run(batches):
        for batch in batches:
            keys, out = [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (reply := handle_line(text, Session(), limit)) is not None:
                    keys.append(k)
                    out.append(reply)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(out, pa.string())], names=["key", "reply"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, reply string").withColumnRenamed("key", key)


def session_replies(stream: DataFrame, limit: int = MAX_BYTES) -> DataFrame:
    """(session, place, reply) of a stream (session string, place long, line string), in order of place within a batch.

    A session's state is whether it is initialised and the version agreed; a second initialize is refused."""

    def answer(key: tuple, frames, state: GroupState):
        known = Session(*state.get) if state.exists else Session()
        rows = pd.concat(list(frames)).sort_values("place")
        out = [(key[0], int(p), r) for p, line in zip(rows["place"], rows["line"], strict=True) if (r := handle_line(line, known, limit)) is not None]
        state.update((known.initialised, known.version))
        yield pd.DataFrame(out, columns=["session", "place", "reply"])

    return stream.groupBy("session").applyInPandasWithState(answer, "session string, place long, reply string", "initialised boolean, version string", "append", GroupStateTimeout.NoTimeout)

"""Answers that are kept in a stream's state: a question that comes again gets the answer of the same state of its application, while that lives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.dossier import ANSWER_SECONDS

RESULT = "application string, id long, question string, answer string, kept boolean"
STATE = "question array<string>, updated array<string>, answer array<string>, at array<double>"


def kept_answers(asked: DataFrame, at: str, seconds: int = ANSWER_SECONDS, delay: str = "1 minute") -> DataFrame:
    """``asked`` (application, id, question, updated, answer: what answering anew would say, and a timestamp) with the answer that is given, and whether it was kept.

    An answer lives for ``seconds`` of the rows' own time from when it was first given, and is of one state of its application (``updated``): another
    one is answered anew. Null answers are never kept. Rows of one batch go by time and id. State holds live answers only; it goes when the
    watermark has passed the last of them, and it is in the checkpoint, so it outlives restarts. Rows later than ``delay`` are left out.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = {(q, u): (a, t) for q, u, a, t in zip(*state.get, strict=True)} if state.exists else {}
        rows, out = pd.concat(list(batches)).sort_values(["at", "id"]), []
        for r in rows.itertuples():
            held = {k: v for k, v in held.items() if v[1] >= r.at - seconds}
            mine = held.get((r.question, r.updated))
            if mine is None and r.answer is not None:
                held[(r.question, r.updated)] = (r.answer, r.at)
            out.append((key[0], r.id, r.question, mine[0] if mine else r.answer, mine is not None))
        state.update(tuple([k[0] for k in held] if i == 0 else [k[1] for k in held] if i == 1 else [v[i - 2] for v in held.values()] for i in range(4)))
        last = max([v[1] for v in held.values()], default=rows["at"].max())
        state.setTimeoutTimestamp(max(int((last + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["application", "id", "question", "answer", "kept"])

    timed = asked.withWatermark(at, delay).select("application", "id", "question", "updated", "answer", F.col(at).alias("_at"), F.col(at).cast("double").alias("at"))
    return timed.groupBy("application").applyInPandasWithState(run, RESULT, STATE, "append", GroupStateTimeout.EventTimeTimeout)

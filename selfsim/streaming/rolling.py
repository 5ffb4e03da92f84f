"""Temporal filters over a stream of planes: chunks finish as soon as their halo is there.

Input rows are planes (n, channel, h, w, v) in any order. State is one chunk of one unit: at
most chunk + 4 radius planes for each channel, replaced by a flag when the chunk is emitted. The end of
the clip is known as frames, so that the last chunks finish without a watermark.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from selfsim.operators.framewise import PLANE, chunk_keys, finished_chunk


def rolling(planes: DataFrame, work: Callable, radius: int, frames: int, channels: Sequence[int] = (0,), chunk: int = 4) -> DataFrame:
    """Finished planes (n, channel, h, w, v) of a stream, each emitted once (append mode).

    All channels are filtered together. A plane that comes twice replaces itself while its
    chunk waits, and is ignored once the chunk is done. Frames outside [0, frames) and null
    samples arrays are dropped. Nothing is emitted for a chunk whose halo never arrives.
    """
    if chunk < 1 or radius < 0 or frames < 1:
        raise ValueError("rolling: chunk and frames must be positive, radius not negative")
    wanted, halo = [int(c) for c in channels], 2 * radius
    inside = planes.where((F.col("n") >= 0) & (F.col("n") < frames) & F.col("v").isNotNull() & F.col("channel").isin(wanted))
    dealt = inside.select(F.explode(F.expr(chunk_keys("n", chunk, halo))).alias("chunk"), *[F.col(c).cast("long") for c in ("n", "channel", "h", "w")], F.col("v").cast("array<double>")).where(F.col("chunk") <= (frames - 1) // chunk)

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last = int(key[0]) * chunk, min((int(key[0]) + 1) * chunk, frames) - 1
        held, done = pickle.loads(state.get[0]) if state.exists else {}, state.exists and state.get[1]
        for pdf in batches:
            if not done:
                held.update({(int(r.n), int(r.channel)): np.array(r.v, float).reshape(r.h, r.w) for r in pdf.itertuples()})
        need = range(max(0, first - halo), min(frames, last + halo + 1))
        if not done and all((n, c) in held for n in need for c in wanted):
            stack = np.stack([np.stack([held[n, c] for c in wanted]) for n in need])
            yield pd.DataFrame(finished_chunk(list(need), stack, wanted, work, radius, lambda n: first <= n <= last), columns=["n", "channel", "h", "w", "v"])
            held, done = {}, True
        state.update((pickle.dumps(held), done))

    return dealt.groupBy("chunk").applyInPandasWithState(step, PLANE, "held binary, done boolean", "append", GroupStateTimeout.NoTimeout)

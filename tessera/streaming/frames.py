"""Frames that arrive over time: the best pass so far, and the canvas after each batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def best_pass(stream: DataFrame) -> DataFrame:
    """(grp, pass, ord, v): the row of the highest pass of every group so far; of equal passes the later. A running
    aggregate, for the update and complete modes."""
    best = stream.groupBy("grp").agg(F.max(F.struct("pass", "ord", "v")).alias("b"))
    return best.select("grp", "b.*")


def windowed_sizes(stream: DataFrame, time: str, late: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """Sections and bytes in windows of time; rows later than ``late`` are left out. For the append mode."""
    windows = stream.withWatermark(time, late).groupBy(F.window(time, every))
    return windows.agg(F.count("*").alias("sections"), F.sum("size").alias("bytes")).select("window.start", "window.end", "sections", "bytes")


def composite(stream: DataFrame) -> DataFrame:
    """(img, frame, colour, alpha): what each image shows after the frames of a batch, laid over what it showed before.

    Frames come in order between batches and in any order within one; an earlier frame than the canvas's is ignored.
    """

    def lay(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frame, colour, alpha = state.get if state.exists else (-1, 0, 0)
        rows = pd.concat(list(batches)).sort_values("frame")
        for r in rows[rows["frame"] > frame].itertuples():
            a = int(r.alpha)
            colour = (int(r.colour) * a + colour * (255 - a) + 127) // 255
            alpha = min(255, a + (alpha * (255 - a) + 127) // 255)
            frame = int(r.frame)
        state.update((frame, colour, alpha))
        yield pd.DataFrame({"img": [key[0]], "frame": [frame], "colour": [colour], "alpha": [alpha]})

    kind = "img long, frame long, colour long, alpha long"
    return stream.groupBy("img").applyInPandasWithState(lay, kind, kind.removeprefix("img long, "), "update", GroupStateTimeout.NoTimeout)

"""Frame filter: keep a sampled frame if it differs enough or enough time has passed (section 2.9 #1)."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import segments
from ..session import stored

#: Difference from which a frame is kept, seconds after which it is kept anyway, factor of the downscaling.
DIFFERENCE, FORCE_S, FACTOR = 0.01, 10.0, 4


def keep_flags(times: np.ndarray, difference: np.ndarray, last: float | None = None, least: float = DIFFERENCE, force: float = FORCE_S) -> tuple[np.ndarray, float | None]:
    """Whether each frame, in order of time, is kept, and the time of the last one that is.

    A frame goes if it differs less than ``least`` from the frame before and
    less than ``force``, in the unit of the times, has passed since the last
    kept frame.
    """
    out = np.empty(len(times), bool)
    for k, (at, diff) in enumerate(zip(times.tolist(), difference.tolist(), strict=True)):
        out[k] = last is None or not (diff < least and at - last < force)
        if out[k]:
            last = at
    return out, last


def _micros(times: pd.Series) -> np.ndarray:
    """Whole microseconds: as seconds they would be rounded."""
    return times.astype("datetime64[us]").astype("int64").to_numpy()


def _runs(part: pd.DataFrame, source: str) -> Iterator[tuple[object, pd.DataFrame]]:
    """Stretches of rows of one source, as they come; null is a source too."""
    name = part[source].to_numpy()
    new = np.ones(len(name), bool)
    new[1:] = [not (a == b or (pd.isna(a) and pd.isna(b))) for a, b in zip(name[1:], name[:-1], strict=True)]
    edge = np.append(np.flatnonzero(new), len(name))
    for lo, hi in zip(edge[:-1], edge[1:], strict=True):
        yield (None if pd.isna(name[lo]) else name[lo]), part.iloc[lo:hi]


def _stretches(part: pd.DataFrame, segment: str, source: str) -> Iterator[tuple[tuple[int, object], pd.DataFrame]]:
    """Stretches of rows of one segment and source, as they come."""
    for number, rows in _runs(part, segment):
        for name, piece in _runs(rows, source):
            yield (int(number), name), piece


def _in_order(df: DataFrame, source: str, *order: str) -> DataFrame:
    """Each source in one partition, in order: Python reads it batch by batch and never holds a source's history."""
    return df.repartition(source).sortWithinPartitions(source, *order)


def last_kept(times: np.ndarray, force: float) -> tuple[np.ndarray, np.ndarray]:
    """Steps (until, last) of frames, in order of time, of which none differs: what is kept last depends on what was kept last before them.

    The first frame that ``force`` has passed for is kept, and from each kept
    one the next; chains soon meet, so few answers are different.  For what was
    last before, ``last`` of the first step whose ``until`` is ``force`` or more
    later holds; after all steps no frame is kept.
    """
    n = len(times)
    after = np.searchsorted(times, times + force)
    end = np.where(after < n, after, np.arange(n))
    while not np.array_equal(end[end], end):
        end = end[end]
    # what was kept before is no later than the first frame
    entry = int(np.searchsorted(times, times[0] + force)) + 1
    last, until = times[end][:entry], times[:entry]
    change = np.flatnonzero(np.append(last[1:] != last[:-1], True))
    return until[change], last[change]


def keep(df: DataFrame, source: str, time: str, key: str, difference: str, least: float = DIFFERENCE, force_s: float = FORCE_S) -> DataFrame:
    """``df`` with kept, source by source, a hot source in many tasks.

    A frame that differs enough is kept whatever was before, so a stretch of a
    source's time is solved by itself from the first such frame on.  The frames
    before it, and a stretch without any, wait for the last kept frame of the
    stretch before: a table with a row for each stretch is walked on the
    driver, and those frames alone are solved again.
    """
    rows = segments.segmented(df, [source], [time, key]).drop(segments.OWNER)
    columns = [F.col(c) for c in df.columns]
    schema = rows.select(*columns, segments.SEGMENT).withColumn("kept", F.lit(None).cast("boolean")).schema
    edge = "segment int, opens boolean, source_first string, source_last string, last double, until array<double>, lasts array<double>"
    by_name = F.to_json(F.struct(F.col(source))).alias("_name")

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Kept of all frames but those that wait, which have null."""
        now, last, segment = object(), None, None
        for part in parts:
            if not len(part):
                continue
            flags = []
            for (number, name), piece in _stretches(part, segments.SEGMENT, source):
                if number != segment:
                    segment, now, last, waits = number, name, None, True
                elif name != now:
                    now, last, waits = name, None, False
                diff = piece[difference].fillna(1.0).to_numpy()
                free = int(np.argmax(diff >= least)) if (diff >= least).any() else len(diff)
                free = free if waits else 0
                waits = waits and free == len(diff)
                kept, last = keep_flags(_micros(piece[time])[free:], diff[free:], last, least, force_s * 1e6)
                flags.append(np.concatenate((np.full(free, None, object), kept.astype(object))))
            yield part.assign(kept=pd.array(np.concatenate(flags), dtype="boolean"))

    def edges(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A row for each stretch: its first and last source, and what is kept last; steps if none of it differs."""
        held: dict = {}

        def row():
            until, lasts = last_kept(np.concatenate(held["waiting"]), force_s * 1e6) if held["whole"] else ((), ())
            return pd.DataFrame({"segment": [held["segment"]], "opens": [not held["whole"]], "source_first": [held["first"]], "source_last": [held["now"]], "last": [held["last"]], "until": [list(until)], "lasts": [list(lasts)]})

        for part in parts:
            for (number, name), piece in _stretches(part, segments.SEGMENT, "_name") if len(part) else ():
                if held.get("segment") != number:
                    if held:
                        yield row()
                    held = {"segment": number, "first": name, "now": name, "last": None, "whole": True, "waiting": []}
                if name != held["now"]:
                    held |= {"now": name, "last": None, "whole": False, "waiting": []}
                times, diff = _micros(piece[time]), piece[difference].fillna(1.0).to_numpy()
                if held["whole"] and not (diff >= least).any():
                    held["waiting"].append(times)
                    continue
                free = int(np.argmax(diff >= least)) if held["whole"] else 0
                held |= {"whole": False, "waiting": []}
                held["last"] = keep_flags(times[free:], diff[free:], held["last"], least, force_s * 1e6)[1]
        if held:
            yield row()

    order = [segments.SEGMENT, source, time, key]
    placed = rows.repartition(segments.SEGMENT).sortWithinPartitions(*order)
    found = {r["segment"]: r for r in placed.select(segments.SEGMENT, by_name, time, difference).mapInPandas(edges, edge).collect()}
    before: dict[int, float | None] = {}
    name, last = object(), None
    for k in sorted(found):
        r = found[k]
        before[k] = last if r["source_first"] == name else None
        if r["opens"]:
            last = r["last"]
        elif before[k] is None:  # its first frame is kept, as a source's first
            last = r["lasts"][0]
        else:
            last = next((v for u, v in zip(r["until"], r["lasts"], strict=True) if u - before[k] >= force_s * 1e6), before[k])
        name = r["source_last"]

    def finish(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segment, last = None, None
        for part in parts:
            if not len(part):
                continue
            flags = []
            for (number, _), piece in _stretches(part, segments.SEGMENT, source):
                if number != segment:
                    segment, last = number, before[number]
                kept, last = keep_flags(_micros(piece[time]), np.zeros(len(piece)), last, least, force_s * 1e6)
                flags.append(kept)
            yield part.assign(kept=pd.array(np.concatenate(flags), dtype="boolean"))

    solved = stored(placed.select(*columns, segments.SEGMENT).mapInPandas(solve, schema), "kept")
    waiting = solved.where("kept is null").repartition(segments.SEGMENT).sortWithinPartitions(*order)
    return solved.where("kept is not null").unionByName(waiting.mapInPandas(finish, schema)).drop(segments.SEGMENT)


def keep_stream(df: DataFrame, source: str, time: str, key: str, difference: str, least: float = DIFFERENCE, force_s: float = FORCE_S) -> DataFrame:
    """``keep`` for a stream: the time of the last kept frame of each source is state.  Frames of a batch go in order of time."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    schema = df.select(source, key, time).withColumn("kept", F.lit(True)).schema

    def run(name, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(parts)).sort_values([time, key])
        flags, last = keep_flags(_micros(part[time]), part[difference].fillna(1.0).to_numpy(), state.get[0] if state.exists else None, least, force_s * 1e6)
        state.update((last,))
        yield part[[source, key, time]].assign(kept=flags)

    return df.groupBy(source).applyInPandasWithState(run, schema, "last double", "append", GroupStateTimeout.NoTimeout)


def read_png(blob: bytes) -> np.ndarray:
    """Gray pixels of a PNG of 8-bit gray or RGB(A); other kinds are an error."""
    if blob[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, wide, high, channels = 8, io.BytesIO(), 0, 0, 1
    while at < len(blob):
        size, kind = struct.unpack(">I4s", blob[at : at + 8])
        body = blob[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            wide, high, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if depth != 8 or color not in (0, 2, 6) or interlace:
                raise ValueError("only 8-bit gray, RGB and RGBA without interlacing")
            channels = {0: 1, 2: 3, 6: 4}[color]
        elif kind == b"IDAT":
            data.write(body)
        at += size + 12
    raw = np.frombuffer(zlib.decompress(data.getvalue()), np.uint8).reshape(high, 1 + wide * channels)
    out = np.zeros((high, wide * channels), np.int32)
    for y in range(high):
        rule, line = raw[y, 0], raw[y, 1:].astype(np.int32)
        up = out[y - 1] if y else np.zeros_like(line)
        if rule == 0:
            out[y] = line
        elif rule == 2:
            out[y] = (line + up) & 255
        else:
            for x in range(len(line)):
                left = out[y, x - channels] if x >= channels else 0
                corner = up[x - channels] if x >= channels else 0
                if rule == 1:
                    guess = left
                elif rule == 3:
                    guess = (left + up[x]) // 2
                else:
                    p = left + up[x] - corner
                    guess = min((left, up[x], corner), key=lambda v: abs(p - v))
                out[y, x] = (line[x] + guess) & 255
    pixels = out.reshape(high, wide, channels)[:, :, :3].astype(float)
    return (pixels[:, :, 0] if channels == 1 else pixels @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def downscale(gray: np.ndarray, factor: int = FACTOR) -> np.ndarray:
    """Nearest pixels."""
    high, wide = max(1, gray.shape[0] // factor), max(1, gray.shape[1] // factor)
    return gray[(np.arange(high) * gray.shape[0]) // high][:, (np.arange(wide) * gray.shape[1]) // wide]


def histogram_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Hellinger distance of two 256-bin histograms."""
    p, q = (np.bincount(x.ravel(), minlength=256) / x.size for x in (a, b))
    return float(np.sqrt(max(0.0, 1.0 - np.sqrt(p * q).sum())))


def differences(df: DataFrame, source: str, time: str, key: str, content: str, factor: int = FACTOR) -> DataFrame:
    """(source, key, time, difference) of PNG frames: from the frame sampled before, kept or not; the first is 1, an equal one 0."""
    schema = df.select(source, key, time).withColumn("difference", F.lit(0.0)).schema

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, before = object(), None
        for part in parts:
            out = []
            for name, rows in _runs(part, source) if len(part) else ():
                if name != now:
                    now, before = name, None
                for blob in rows[content]:
                    image = downscale(read_png(bytes(blob)), factor)
                    out.append(1.0 if before is None else 0.0 if np.array_equal(image, before) else histogram_distance(before, image))
                    before = image
            yield part[[source, key, time]].assign(difference=out)

    return _in_order(df, source, time, key).mapInPandas(run, schema)

"""Packets, sample tables and stream reassembly as relational operators.

Packets are rows ``(file, idx, ordinal, pts, dts, duration, size, keyframe)``.
Windows are partitioned by file or stream and spill; folds that have to go in
order stream a sorted partition with constant memory instead of collecting it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut, deal
from .scan import carry_scan


# --- joins -------------------------------------------------------------------


def join_streams(packets: DataFrame, streams: DataFrame) -> DataFrame:
    """Packets with their stream's columns; packets of unknown streams drop."""
    return packets.join(streams, ["file", "idx"])


def join_track(blocks: DataFrame, tracks: DataFrame) -> DataFrame:
    """Blocks with the index of the first track that has their number."""
    first = tracks.groupBy("file", "track_number").agg(F.min("idx").alias("idx"))
    return blocks.join(first, ["file", "track_number"])


def map_streams(inputs: list[DataFrame], selection: DataFrame) -> DataFrame:
    """Packets of several inputs in one output: ``selection(input, idx,
    out_idx)`` keeps and renumbers; a stream selected twice appears twice."""
    out = None
    for i, df in enumerate(inputs):
        part = df.withColumn("input", F.lit(i).cast("bigint"))
        out = part if out is None else out.unionByName(part)
    return out.join(selection, ["input", "idx"]).drop("idx").withColumnRenamed("out_idx", "idx")


# --- sample tables -----------------------------------------------------------


def chunk_runs(stsc: DataFrame, chunks: DataFrame) -> DataFrame:
    """``file, chunk, spc``: samples in each chunk, from the last run that
    starts at or before it.

    Runs expand to the chunks they cover and join by equality, which avoids a
    range join; chunks before the first run have none and drop."""
    last = chunks.groupBy("file").agg(F.max("chunk").alias("last"))
    w = Window.partitionBy("file").orderBy("first_chunk")
    runs = stsc.hint("merge").join(last, "file").withColumn("to", F.coalesce(F.lead("first_chunk").over(w) - 1, F.col("last")))
    runs = runs.where("to >= first_chunk").select("file", "spc", F.explode(F.sequence("first_chunk", F.least("to", "last"))).alias("chunk"))
    return runs.join(chunks.select("file", "chunk").hint("merge"), ["file", "chunk"])


def mp4_samples(stsc: DataFrame, chunks: DataFrame, sizes: DataFrame, stts: DataFrame, stss: DataFrame | None) -> DataFrame:
    """``file, sample, chunk, offset, size, pts, keyframe`` of a sample table.

    ``chunks(file, chunk, offset)``, ``sizes(file, sample, size)``, ``stts(file,
    entry, count, delta)`` run-length time steps, ``stss(file, sample)`` sync
    samples; files without any are all sync.  Samples past the sizes or the time
    steps: the former do not exist, the latter have pts 0.

    Tables that tasks read out of files look small to the optimizer, whatever is in
    them: joins with rows for each sample or chunk are merged, never broadcast.
    """
    runs = chunk_runs(stsc, chunks).where("spc > 0")
    before = Window.partitionBy("file").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.withColumn("first", F.coalesce(F.sum("spc").over(before), F.lit(0)) + 1)
    placed = placed.select("file", "chunk", F.explode(F.expr("sequence(first, first + spc - 1)")).alias("sample"))
    s = placed.join(sizes.hint("merge"), ["file", "sample"]).join(chunks.hint("merge"), ["file", "chunk"])
    in_chunk = Window.partitionBy("file", "chunk").orderBy("sample").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("offset", F.col("offset") + F.coalesce(F.sum("size").over(in_chunk), F.lit(0)))
    by_entry = Window.partitionBy("file").orderBy("entry").rowsBetween(Window.unboundedPreceding, -1)
    most = sizes.groupBy("file").agg(F.max("sample").alias("most"))
    t = (
        stts.where("count > 0").withColumns({"s0": F.coalesce(F.sum("count").over(by_entry), F.lit(0)), "t0": F.coalesce(F.sum(F.col("count") * F.col("delta")).over(by_entry), F.lit(0))})
        .hint("merge").join(most, "file").where("s0 < most")
        .select("file", "delta", "s0", "t0", F.explode(F.expr("sequence(s0 + 1, least(s0 + count, most))")).alias("sample"))
        .selectExpr("file", "sample", "t0 + (sample - s0 - 1) * delta as pts")
    )
    s = s.join(t.hint("merge"), ["file", "sample"], "left").withColumn("pts", F.coalesce("pts", F.lit(0).cast("bigint")))
    if stss is None:
        s = s.withColumn("keyframe", F.lit(True))
    else:
        key = stss.select("file", "sample", F.lit(True).alias("sync")).distinct()
        files = stss.select("file", F.lit(True).alias("has")).distinct()
        s = s.join(key.hint("merge"), ["file", "sample"], "left").join(files, "file", "left")
        s = s.withColumn("keyframe", F.col("has").isNull() | F.col("sync").isNotNull())
    return s.select("file", "sample", "chunk", "offset", "size", "pts", "keyframe")


def sample_durations(packets: DataFrame, nominal: Column) -> DataFrame:
    """``duration`` from pts steps; the last repeats the last positive step.
    Streams with a missing or falling pts, or no progress, get ``nominal``."""
    stream = Window.partitionBy("file", "idx")
    w = stream.orderBy("ordinal")
    p = packets.withColumns({"step": F.lead("pts").over(w) - F.col("pts")})
    p = p.withColumns({
        "fine": (F.count("*").over(stream) >= 2) & (F.count("pts").over(stream) == F.count("*").over(stream)) & F.coalesce(F.min("step").over(stream) >= 0, F.lit(False)) & (F.max("pts").over(stream) > F.min("pts").over(stream)),
        "tail": F.last(F.when(F.col("step") > 0, F.col("step")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    })
    return p.withColumn("duration", F.when(F.col("fine"), F.coalesce("step", "tail")).otherwise(nominal)).drop("step", "fine", "tail")


def interleave(samples: DataFrame, data_start: int) -> DataFrame:
    """Samples of all tracks of a file in time order with offset and chunk.

    ``samples(file, idx, ordinal, duration, timescale, size)``.  Order: start
    second, then track, then sample.  A run of one track is a chunk.
    """
    before = Window.partitionBy("file", "idx").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    s = samples.withColumn("start_s", F.coalesce(F.sum("duration").over(before), F.lit(0)) / F.greatest(F.col("timescale"), F.lit(1)).cast("double"))
    order = Window.partitionBy("file").orderBy("start_s", "idx", "ordinal")
    s = s.withColumns({
        "position": F.row_number().over(order).cast("bigint"),
        "offset": F.lit(data_start) + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"),
        "opens": F.coalesce((F.lag("idx").over(order) != F.col("idx")).cast("bigint"), F.lit(1).cast("bigint")),
    })
    of_track = Window.partitionBy("file", "idx").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return s.withColumn("chunk", F.sum("opens").over(of_track)).drop("opens")


def chunk_table(interleaved: DataFrame) -> DataFrame:
    """``file, idx, chunk, offset, samples``."""
    return interleaved.groupBy("file", "idx", "chunk").agg(F.min("offset").alias("offset"), F.count("*").alias("samples"))


# --- reassembly --------------------------------------------------------------


def lace_packets(segments: DataFrame) -> DataFrame:
    """Packets from lacing values ``(file, page, seg, lace)``: a value under 255
    ends a packet, also across pages; an unfinished last one is left out."""
    before = Window.partitionBy("file").orderBy("page", "seg").rowsBetween(Window.unboundedPreceding, -1)
    s = segments.withColumn("packet", F.coalesce(F.sum((F.col("lace") < 255).cast("bigint")).over(before), F.lit(0).cast("bigint")))
    g = s.groupBy("file", "packet").agg(F.sum("lace").alias("size"), F.count("*").alias("segments"), F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.min("lace").alias("least"))
    return g.where("least < 255").drop("least")


def pes_packets(ts: DataFrame) -> DataFrame:
    """PES packets from transport packets ``(file, ord, pid, pusi, rai, expect,
    len)``: one starts at each unit start of its PID and ends before the next, or
    once it has ``expect`` bytes; packets before the first start are dropped."""
    w = Window.partitionBy("file", "pid").orderBy("ord")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = ts.withColumn("pes", F.sum(F.col("pusi").cast("bigint")).over(upto)).where("pes > 0")
    inside = Window.partitionBy("file", "pid", "pes").orderBy("ord")
    t = t.withColumns({
        "had": F.coalesce(F.sum("len").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "want": F.first("expect").over(inside), "key": F.first("rai").over(inside),
    }).where("want = 0 or had < want")
    return t.groupBy("file", "pid", "pes").agg(F.sum("len").alias("size"), F.count("*").alias("parts"), F.bool_and("key").alias("keyframe"), F.min("ord").alias("first_ord"))


def hls_segments(packets: DataFrame, target: float, has_video: bool = True, least: float = 0.5) -> DataFrame:
    """Segment number and start of each packet of a reference stream; for many
    streams of a length that one task can read (see :func:`hls_segments_spread`).

    ``packets(file, ordinal, pts, tb_num, tb_den, keyframe)``.  A segment closes
    once it has lasted ``target`` seconds (at least ``least``) at a keyframe, or
    at any packet without video, so each boundary depends on the one before.
    Partitions are sorted and streamed with one file's state in memory.
    """
    goal = max(target, least)
    dealt = packets.select("file", "ordinal", "pts", "tb_num", "tb_den", "keyframe").where("pts is not null")
    dealt = deal(dealt, "file").sortWithinPartitions("file", "ordinal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, start, number = object(), 0, 0
        for b in batches:
            n = b.num_rows
            no, st = np.empty(n, np.int64), np.empty(n, np.int64)
            cols = [b.column(c).to_pylist() for c in ("file", "pts", "tb_num", "tb_den", "keyframe")]
            for i, (file, pts, num, den, key) in enumerate(zip(*cols)):
                if file != now:
                    now, start, number = file, pts, 0
                elif (pts - start) * num / max(den, 1) >= goal and (key or not has_video):
                    start, number = pts, number + 1
                no[i], st[i] = number, start
            yield pa.RecordBatch.from_arrays(
                [b.column("file"), b.column("ordinal"), b.column("pts"), b.column("tb_num"), b.column("tb_den"), pa.array(no), pa.array(st)],
                ["file", "ordinal", "pts", "tb_num", "tb_den", "segment", "start_pts"],
            )

    kind = dict(packets.dtypes)
    return dealt.mapInArrow(run, f"file {kind['file']}, ordinal bigint, pts bigint, tb_num bigint, tb_den bigint, segment bigint, start_pts bigint")


def _pointers(links: DataFrame) -> list[DataFrame]:
    """Tables ``file, u, v`` of ``links`` taken once, twice, four times and so on,
    as long as any lead somewhere."""
    levels = [cut(links)]
    while True:
        a, b = levels[-1].alias("a"), levels[-1].alias("b")
        twice = cut(a.join(b, (F.col("a.file") == F.col("b.file")) & (F.col("a.v") == F.col("b.u"))).select("a.file", "a.u", "b.v"))
        if twice.isEmpty():
            return levels
        levels.append(twice)


def hls_segments_spread(packets: DataFrame, target: float, has_video: bool = True, least: float = 0.5, blocks: int | None = None) -> DataFrame:
    """As :func:`hls_segments`, with one stream spread over many tasks.

    Where a segment that begins at a packet would end is a range lookup: the first
    possible boundary whose time is the goal later.  These pointers are doubled, so
    the boundaries that can be reached from the first packet are found and numbered
    in as many rounds as the number of segments has binary digits, and a carry scan
    hands them to the packets.  Times may fall between boundaries: a boundary is
    always later than every possible boundary before it, so only those that are
    later than all before (by a running maximum) take part.  ``tb_num`` and
    ``tb_den`` are positive; the goal has to be.
    """
    goal = max(target, least)
    if goal <= 0:
        raise ValueError("segments need a positive length")
    p = packets.select("file", "ordinal", "pts", "tb_num", "tb_den", "keyframe").where("pts is not null")
    seconds = lambda d: d * F.col("tb_num") / F.greatest(F.col("tb_den"), F.lit(1))
    about = F.ceil(F.lit(goal) * F.greatest(F.col("tb_den"), F.lit(1)) / F.col("tb_num")).cast("bigint")
    need = F.when(seconds(about - 1) >= goal, about - 1).when(seconds(about) < goal, about + 1).otherwise(about)
    opens = F.col("_before") == 0
    possible = carry_scan(p, ["file"], ["ordinal"], {"_before": ("count", "pts")}, blocks, exclusive=True).where(opens | F.col("keyframe") if has_video else F.lit(True))
    nodes = carry_scan(cut(possible), ["file"], ["ordinal"], {"_high": ("max", "pts")}, blocks, exclusive=True).where("_high is null or pts > _high")
    nodes = cut(nodes.select("file", "ordinal", "pts", (F.col("pts") + need).alias("until"), opens.alias("opens")))
    ends = nodes.select("file", F.col("until").alias("at"), F.lit(0).alias("kind"), F.col("ordinal").alias("u"), F.lit(None).cast("bigint").alias("v"))
    begins = nodes.select("file", F.col("pts").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("u"), F.col("ordinal").alias("v"))
    found = carry_scan(ends.unionByName(begins), ["file"], ["at", "kind"], {"next": ("last", "v")}, blocks, reverse=True)
    links = found.where("kind = 0 and next is not null").select("file", "u", F.col("next").alias("v"))
    reached = nodes.where("opens").select("file", F.col("ordinal").alias("u"), F.lit(0).cast("bigint").alias("segment"))
    for k, level in reversed(list(enumerate(_pointers(links)))):
        step = reached.join(level, ["file", "u"]).select("file", F.col("v").alias("u"), (F.col("segment") + (1 << k)).alias("segment"))
        reached = cut(reached.unionByName(step))
    starts = reached.withColumnRenamed("u", "ordinal").join(nodes.select("file", "ordinal", F.col("pts").alias("start_pts")), ["file", "ordinal"])
    marked = p.join(starts, ["file", "ordinal"], "left").withColumnsRenamed({"segment": "_segment", "start_pts": "_start"})
    out = carry_scan(cut(marked), ["file"], ["ordinal"], {"segment": ("last", "_segment"), "start_pts": ("last", "_start")}, blocks)
    return out.select("file", "ordinal", "pts", "tb_num", "tb_den", "segment", "start_pts")


def hls_durations(segmented: DataFrame, target: float) -> DataFrame:
    """``file, segment, start_pts, packets, duration`` in seconds: up to the next
    segment's start, the last up to its last pts, ``target`` where that is 0."""
    g = segmented.groupBy("file", "segment").agg(F.min("start_pts").alias("start_pts"), F.max("pts").alias("last_pts"), F.count("*").alias("packets"), F.max("tb_num").alias("n"), F.max("tb_den").alias("d"))
    w = Window.partitionBy("file").orderBy("segment")
    end = F.coalesce(F.lead("start_pts").over(w), F.col("last_pts"))
    dur = F.when(end > F.col("start_pts"), (end - F.col("start_pts")) * F.col("n") / F.greatest(F.col("d"), F.lit(1)).cast("double")).otherwise(F.lit(float(target)))
    return g.select("file", "segment", "start_pts", "packets", dur.alias("duration"))


def hls_playlist(durations: DataFrame, target: float) -> DataFrame:
    """``file, playlist``: the text of each file's media playlist; durations are
    rounded half up to the millisecond."""
    item = F.format_string("#EXTINF:%.3f,\n%s%d.ts\n", F.floor(F.col("duration") * 1000 + 0.5) / 1000, F.col("file").cast("string"), F.col("segment"))
    g = durations.groupBy("file").agg(
        F.greatest(F.ceil(F.greatest(F.max("duration"), F.lit(float(target)))), F.lit(1)).cast("bigint").alias("t"),
        F.array_sort(F.collect_list(F.struct("segment", item.alias("item")))).alias("items"),
    )
    body = F.array_join(F.transform("items", lambda x: x["item"]), "")
    head = F.concat(F.lit("#EXTM3U\n#EXT-X-VERSION:3\n#EXT-X-TARGETDURATION:"), F.col("t").cast("string"), F.lit("\n#EXT-X-MEDIA-SEQUENCE:0\n#EXT-X-PLAYLIST-TYPE:VOD\n"))
    return g.select("file", F.concat(head, body, F.lit("#EXT-X-ENDLIST\n")).alias("playlist"))


# --- windows, limits and order -----------------------------------------------


def running_pts(packets: DataFrame, duration: str = "duration", blocks: int | None = None) -> DataFrame:
    """Start time of each packet as the sum of the durations before it; with
    ``blocks`` a long stream is spread over so many tasks."""
    if blocks:
        return carry_scan(packets, ["file", "idx"], ["ordinal"], {"pts": ("sum", duration)}, blocks, exclusive=True).withColumn("pts", F.coalesce("pts", F.lit(0).cast("bigint")))
    before = Window.partitionBy("file", "idx").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return packets.withColumn("pts", F.coalesce(F.sum(duration).over(before), F.lit(0).cast("bigint")))


def limit_frames(packets: DataFrame, n: int) -> DataFrame:
    """The first ``n`` packets of each stream (a top-k of each group)."""
    w = Window.partitionBy("file", "idx").orderBy("ordinal")
    return packets.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def lookahead(packets: DataFrame, lag: int) -> DataFrame:
    """With ``release_pts``: the time of the packet, ``lag`` later in its stream,
    whose arrival lets this one leave the encoder; at the end the last one's."""
    w = Window.partitionBy("file", "idx").orderBy("ordinal")
    return packets.withColumn("release_pts", F.coalesce(F.lead("pts", lag).over(w), F.last("pts").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))


def bounded_scan(packets: DataFrame, most: int) -> DataFrame:
    """Streams that show up within the first ``most`` packets of a file, in order of
    time, stream and ordinal: ``file, idx, packets, first_pts``.  What a reader
    learns from a bounded look; the window keeps ``most`` rows a file map-side."""
    w = Window.partitionBy("file").orderBy("pts", "idx", "ordinal")
    seen = packets.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    return seen.groupBy("file", "idx").agg(F.count("*").alias("packets"), F.min("pts").alias("first_pts"))


def frame_blocks(samples: DataFrame, size: int, hop: int, total: Column) -> DataFrame:
    """Each sample with every analysis block ``[k * hop, k * hop + size)`` that
    holds it and fits into ``total`` samples: at most ``size / hop`` rows each."""
    first = F.greatest(F.ceil((F.col("n") - size + 1) / hop), F.lit(0)).cast("bigint")
    last = F.least(F.floor(F.col("n") / hop), F.floor((total - size) / hop)).cast("bigint")
    return samples.where(last >= first).withColumn("block", F.explode(F.sequence(first, last)))


def warmup_chunks(frames: DataFrame, size: int, warmup: int, total: Column) -> DataFrame:
    """Each frame in the chunk it belongs to and, as warm-up, in the next one
    where it lies up to ``warmup`` frames before that chunk."""
    own = F.floor(F.col("n") / size).cast("bigint")
    nxt = F.when((F.col("n") % size >= size - warmup) & ((own + 1) * size < total), own + 1)
    both = F.array_compact(F.array(own, nxt))
    return frames.withColumn("chunk", F.explode(both)).withColumn("warmup", F.col("chunk") != own)


def dedup_consecutive(df: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one just before them in order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_p", F.lag(value).over(w)).withColumn("_i", F.row_number().over(w)).where(F.expr(f"_i = 1 or not ({value} <=> _p)")).drop("_p", "_i")

"""Keyframe-aligned segments, live windows, playlists and their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof
from .greedy import greedy
from .staging import stage


def keyframe_cuts(packets: DataFrame, duration: int, kind: str = "video", most: int | None = None) -> DataFrame:
    """(stream_id, segment, at): where segments begin, the first at the stream's first packet.

    A new one begins at the first keyframe of ``kind`` that is at least ``duration`` after the
    current one's beginning: greedy, no fixed grid. A stream without packets of ``kind`` may cut at
    any packet. Only possible cut points (one per group of pictures) are shuffled; a stream with more
    than ``most`` of them is spread over tasks. Packets without a stream are in no segment.
    """
    first = packets.where("stream_id is not null").groupBy("stream_id").agg(F.min("pts").alias("first"), F.max((F.col("kind") == kind).cast("int")).alias("has"))
    points = packets.join(first, "stream_id").where((F.col("has") == 0) | ((F.col("kind") == kind) & F.col("is_key")))
    key = F.col("stream_id").cast("bigint").alias("key")
    cuts = greedy(points.select(key, F.col("pts").alias("v")), first.select(key, F.col("first").alias("v")), duration, most)
    return cuts.select(F.col("key").alias("stream_id"), F.col("n").alias("segment"), F.col("v").alias("at"))


def segment(packets: DataFrame, duration: int, kind: str = "video", most: int | None = None, tracks: DataFrame | None = None) -> DataFrame:
    """``packets`` with their segment; all tracks of a stream are cut together. ``tracks`` (stream_id,
    track_id) are those that are kept: cuts count from the stream's first packet of any track. The
    cuts are found once and written."""
    cuts = stage(keyframe_cuts(packets, duration, kind, most), "cuts").withColumnRenamed("at", "pts")
    kept = packets if tracks is None else packets.join(tracks.select("stream_id", "track_id").distinct(), ["stream_id", "track_id"], "left_semi")
    return asof(kept, cuts, ["stream_id"], "pts", F.col("segment"), most=most).withColumnRenamed("known", "segment")


def segment_summary(segmented: DataFrame) -> DataFrame:
    end = F.col("pts") + F.col("duration")
    return segmented.groupBy("stream_id", "segment").agg(
        F.min("pts").alias("start_pts"), F.max(end).alias("end_pts"), (F.max(end) - F.min("pts")).alias("duration"), F.count_if(F.col("kind") == "video").alias("video_packets"), F.count_if(F.col("kind") == "audio").alias("audio_packets"),
        F.sum("size").alias("bytes"), F.min_by(F.col("is_key") & (F.col("kind") == "video"), F.struct("pts", "seq")).alias("starts_with_key"),
    )


def live_window(segments: DataFrame, size: int | None, complete_only: bool = True) -> DataFrame:
    """The newest ``size`` completed segments of each stream (all of them for None, as event and
    on-demand playlists keep), with media_sequence: the index of the oldest kept. The newest segment
    of a live stream is still open."""
    w = Window.partitionBy("stream_id").orderBy(F.desc("segment"))
    ranked = segments.withColumn("_rank", F.row_number().over(w) - int(complete_only))
    kept = ranked.where("_rank >= 1" + (f" and _rank <= {size}" if size is not None else ""))
    return kept.withColumn("media_sequence", F.min("segment").over(Window.partitionBy("stream_id"))).drop("_rank")


def expired_segments(written: DataFrame, listed: DataFrame) -> DataFrame:
    """Files (stream_id, segment) that no playlist names any more."""
    return written.select("stream_id", "segment").distinct().exceptAll(listed.select("stream_id", "segment").distinct())


def has_integer_conversion(pattern: Column) -> Column:
    """Whether a name pattern has exactly one integer conversion (%d, %05d); %% is a literal."""
    plain = F.regexp_replace(pattern, "%%", "")
    return F.coalesce(F.regexp_count(plain, F.lit("%[0-9]*d")) == 1, F.lit(False)) & ~F.coalesce(F.regexp_replace(plain, "%[0-9]*d", "").contains("%"), F.lit(True))


def segment_name(pattern: str | Column, index: Column) -> Column:
    """The name of one segment; null for a pattern without an integer conversion."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.when(has_integer_conversion(p), F.call_function("format_string", p, index) if not isinstance(pattern, str) else F.format_string(pattern, index))


def playlist_text(segments: DataFrame, pattern: str = "segment_%05d.ts", base_url: str = "", kind: str | None = None, init: str | None = None, final: bool = False, ticks: int = 1_000_000) -> DataFrame:
    """(stream_id, playlist): one text per stream over its ``segments`` (stream_id, segment,
    duration in ticks, media_sequence). kind is the playlist type (EVENT or VOD), init names the
    initialisation file, final ends the list. A playlist is one text, so all entries of a stream meet in
    one row: a year of four-second segments is 8 million entries, some 400 MB."""
    if "%" in pattern and pattern.replace("%%", "").count("%") != 1:
        raise ValueError("the pattern needs one integer conversion")
    entry = F.concat(F.lit("#EXTINF:"), F.format_string("%.6f", F.col("duration") / ticks), F.lit(",\n"), F.lit(base_url), segment_name(pattern, F.col("segment")))
    rows = segments.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("segment", entry.alias("text")))).alias("entries"), F.ceil(F.max("duration") / ticks).alias("target"), F.min("media_sequence").alias("sequence"))
    head = [F.lit("#EXTM3U"), F.lit(f"#EXT-X-VERSION:{7 if init else 3}"), F.concat(F.lit("#EXT-X-TARGETDURATION:"), F.greatest(F.lit(1), F.col("target")).cast("string")), F.concat(F.lit("#EXT-X-MEDIA-SEQUENCE:"), F.col("sequence").cast("string"))]
    head += [F.lit(f"#EXT-X-PLAYLIST-TYPE:{kind}")] if kind else []
    head += [F.lit(f'#EXT-X-MAP:URI="{base_url}{init}"')] if init else []
    tail = [F.lit("#EXT-X-ENDLIST")] if final else []
    return rows.select("stream_id", F.concat_ws("\n", *head, F.transform("entries", lambda e: e["text"]), *tail).alias("playlist"))


def write_segments(segmented: DataFrame, path: str, pattern: str = "rec_%04d") -> None:
    """Parquet files of whole segments, told by stream_id and name. A segment lies in one file, in order;
    short ones share a file, as one of its own for each would cost far more than its packets. Files hold
    ranges of streams and segments, so a reader of one finds its file, and place, by the statistics."""
    named = segmented.withColumn("name", segment_name(pattern, F.col("segment")))
    named.repartitionByRange("stream_id", "segment").sortWithinPartitions("stream_id", "segment", "dts", "track_id", "seq").write.parquet(path)


def write_playlist(playlists: DataFrame, path: str, each: bool = False) -> None:
    """Parquet files of whole playlists, line by line: stream_id, line (from 0) and value. A playlist lies in
    one file, in order; many share a file, told by ranges of streams, so a reader of one finds its place by
    the statistics. ``each`` writes a folder with a text file for each stream instead, which a player reads
    as it is: for some thousands of streams, as such a file costs far more than its text."""
    if each:
        playlists.select("stream_id", "playlist").write.partitionBy("stream_id").text(path)
        return
    lines = F.split(F.coalesce("playlist", F.lit("")), "\n", -1)
    ordered = playlists.select("stream_id", "playlist").repartitionByRange("stream_id").sortWithinPartitions("stream_id")
    ordered.select("stream_id", F.posexplode(lines).alias("line", "value")).write.parquet(path)

"""Detection tables: confirmation, shots, pairs, groups, presence, pixel statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuewise.functions.geometry import Frame, area, iou, panel_rect
from cuewise.operators.scan import Scan, asof, chunk_of, running, sliding

BOX = ("x", "y", "w", "h", "score")


def boxed(dets: DataFrame) -> DataFrame:
    return dets.select("video_id", "frame", "det", F.struct(*BOX).alias("box"))


def _previous(faces: DataFrame) -> DataFrame:
    """A frame's faces addressed to the frame after it."""
    return faces.select(F.col("video_id").alias("pv"), (F.col("frame") + 1).alias("pf"),
                        F.col("box").alias("pbox"))


def near_previous(faces: DataFrame, previous: DataFrame, threshold: float, how: str, strict: bool) -> DataFrame:
    """Faces with (``left_semi``) or without (``left_anti``) an overlapping face one frame before."""
    p = _previous(previous)
    overlap = iou("box", "pbox")
    hit = overlap > threshold if strict else overlap >= threshold
    return faces.join(p, (F.col("video_id") == F.col("pv")) & (F.col("frame") == F.col("pf")) & hit, how)


def confirm(faces: DataFrame) -> DataFrame:
    """Confident detections, and weak ones that overlap a raw detection of the frame before."""
    sure = faces.filter(F.col("box.score") >= 0.65)
    weak = faces.filter(F.col("box.score") < 0.65)
    return sure.unionByName(near_previous(weak, faces, 0.3, "left_semi", True))


def shot_candidates(hashes: DataFrame, kept: DataFrame, bits: int = 16) -> DataFrame:
    """Frames whose hash jumps from the frame before while no kept face carries over."""
    prev = hashes.select("video_id", (F.col("frame") + 1).alias("frame"), F.col("hash").alias("prev_hash"))
    jumped = hashes.join(prev, ["video_id", "frame"]).filter(
        F.bit_count(F.col("hash").bitwiseXOR(F.col("prev_hash"))) > bits)
    same = near_previous(kept, kept, 0.15, "left_semi", False).select("video_id", "frame").distinct()
    return jumped.join(same, ["video_id", "frame"], "left_anti").select("video_id", "frame")


def pairs(faces: DataFrame, src_w: float) -> DataFrame:
    """Two people side by side: the two most prominent confident faces of a frame, alike in size
    and apart; left one first."""
    top = Window.partitionBy("video_id", "frame").orderBy(F.desc(area("box") * F.col("box.score")), "det")
    two = faces.filter(F.col("box.score") >= 0.6).withColumn("n", F.row_number().over(top)).filter("n <= 2")
    wide = two.groupBy("video_id", "frame").agg(
        F.max(F.when(F.col("n") == 1, F.col("box"))).alias("a"),
        F.max(F.when(F.col("n") == 2, F.col("box"))).alias("b"))
    ca, cb = F.col("a.x") + F.col("a.w") / 2, F.col("b.x") + F.col("b.w") / 2
    alike = F.least("a.h", "b.h") >= 0.6 * F.greatest("a.h", "b.h")
    ok = wide.filter(F.col("b").isNotNull() & alike & (F.abs(ca - cb) >= 0.2 * src_w))
    left_first = ca <= cb
    return ok.select("video_id", "frame", F.when(left_first, F.col("a")).otherwise(F.col("b")).alias("l"),
                     F.when(left_first, F.col("b")).otherwise(F.col("a")).alias("r"))


def _frame_faces(faces: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per frame with its faces best first (a frame holds tens of faces at most)."""
    best = F.array_sort(F.collect_list(F.struct((-F.col("box.score")).alias("s"), "det", "box")))
    return faces.groupBy("video_id", "frame").agg((F.slice(best, 1, limit) if limit else best).alias("faces"))


def suppress(faces: DataFrame, threshold: float, top_k: int) -> DataFrame:
    """Greedy non-maximum suppression per frame over the ``top_k`` best faces."""
    per = _frame_faces(faces, max(top_k, 1))

    def step(kept: Column, f: Column) -> Column:
        clear = F.forall(kept, lambda k: iou(f["box"], k["box"]) < threshold)
        return F.when(clear, F.array_append(kept, f)).otherwise(kept)

    kept = F.aggregate("faces", F.filter("faces", lambda x: F.lit(False)), step)
    return per.select("video_id", "frame", F.explode(kept).alias("f")).select(
        "video_id", "frame", "f.det", "f.box")


def cluster_members(faces: DataFrame, base_w: float) -> DataFrame:
    """Faces that form one conversation: best first, confident, of a size, distinct, together
    within three quarters of the base window; at least two."""
    per = _frame_faces(faces).withColumn("tallest", F.array_max(F.transform("faces", lambda f: f["box"]["h"])))

    def step(acc: Column, f: Column) -> Column:
        b = f["box"]
        fits = (b["score"] >= 0.6) & (b["h"] >= 0.5 * F.col("tallest"))
        cx = b["x"] + b["w"] / 2
        distinct = F.forall(acc["m"], lambda g: (iou(b, g["box"]) < 0.15) & (
            F.abs(cx - (g["box"]["x"] + g["box"]["w"] / 2)) > 0.6 * F.greatest(b["w"], g["box"]["w"])))
        x1, x2 = F.least(acc["x1"], b["x"]), F.greatest(acc["x2"], b["x"] + b["w"])
        ok = fits & distinct & (x2 - x1 <= 0.75 * base_w)
        return F.struct(F.when(ok, x1).otherwise(acc["x1"]).alias("x1"),
                        F.when(ok, x2).otherwise(acc["x2"]).alias("x2"),
                        F.when(ok, F.array_append(acc["m"], f)).otherwise(acc["m"]).alias("m"))

    start = F.struct(F.lit(float("inf")).alias("x1"), F.lit(float("-inf")).alias("x2"),
                     F.filter("faces", lambda x: F.lit(False)).alias("m"))
    found = per.withColumn("m", F.aggregate("faces", start, step, lambda a: a["m"])).filter(F.size("m") >= 2)
    return found.select("video_id", "frame", F.posexplode("m").alias("n", "f")).select(
        "video_id", "frame", "n", "f.det", "f.box")


def group_windows(members: DataFrame, f: Frame) -> DataFrame:
    """Base window over a frame's group; absent when it would cut a member off."""
    _, _, bw, bh = f.base
    margin = 0.12 * bw
    g = members.groupBy("video_id", "frame").agg(
        (F.min("box.x") - margin).alias("x1"), (F.max(F.col("box.x") + F.col("box.w")) + margin).alias("x2"),
        F.min("box.x").alias("lo"), F.max(F.col("box.x") + F.col("box.w")).alias("hi"),
        F.avg(F.col("box.y") + F.col("box.h") / 2).alias("cy"), F.count("*").alias("n"))
    g = g.filter((F.col("n") >= 2) & (F.col("x2") - F.col("x1") <= bw))
    g = g.withColumn("x2", F.when(F.col("x1") < 0, F.col("x2") - F.col("x1")).otherwise(F.col("x2")))
    g = g.withColumn("x1", F.greatest("x1", F.lit(0.0)))
    g = g.withColumn("x1", F.when(F.col("x2") > f.src_w, F.col("x1") - (F.col("x2") - f.src_w)).otherwise(F.col("x1")))
    g = g.withColumn("x2", F.least("x2", F.lit(float(f.src_w))))
    w, h = min(bw, f.src_w), min(bh, f.src_h)
    x = F.least(F.greatest((F.col("x1") + F.col("x2")) / 2 - w / 2, F.lit(0.0)), F.lit(max(f.src_w - w, 0.0)))
    y = F.least(F.greatest(F.col("cy") - h * 0.4, F.lit(0.0)), F.lit(max(f.src_h - h, 0.0)))
    g = g.withColumn("x", x).withColumn("y", y)
    return g.filter((F.col("lo") >= F.col("x") - 1) & (F.col("hi") <= F.col("x") + w + 1)).select(
        "video_id", "frame", "x", "y", F.lit(w).alias("w"), F.lit(h).alias("h"))


def upper_median(c) -> Column:
    """The element at half the count of the sorted values."""
    v = F.sort_array(F.collect_list(c))
    return F.element_at(v, (F.floor(F.size(v) / 2) + 1).cast("int"))


def _upper_medians(rows: DataFrame, group: list[str], cols: list[str]) -> DataFrame:
    """Upper medians by rank, so that a large group is sorted by the engine and never collected."""
    long = rows.select(*group, F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x")).select(*group, "x.*")
    counts = long.groupBy(*group, "name", "v").agg(F.count("*").alias("c"))
    one = Window.partitionBy(*group, "name")
    m = counts.select("*", F.sum("c").over(one.orderBy("v")).alias("upto"), F.floor(F.sum("c").over(one) / 2).alias("half"))
    m = m.filter((F.col("upto") > F.col("half")) & (F.col("upto") - F.col("c") <= F.col("half")))
    return m.groupBy(*group).agg(*[F.max(F.when(F.col("name") == c, F.col("v"))).alias(c) for c in cols])


def typical_faces(pair_rows: DataFrame, group: list[str]) -> DataFrame:
    """Median left and right face of each group (centres and sizes)."""
    flat = pair_rows.select(
        *group, *[e for s in ("l", "r") for e in (
            (F.col(f"{s}.x") + F.col(f"{s}.w") / 2).alias(f"{s}x"), (F.col(f"{s}.y") + F.col(f"{s}.h") / 2).alias(f"{s}y"),
            F.col(f"{s}.w").alias(f"{s}w"), F.col(f"{s}.h").alias(f"{s}h"))])
    return _upper_medians(flat, group, ["lx", "ly", "lw", "lh", "rx", "ry", "rw", "rh"])


def with_panels(faces: DataFrame, f: Frame, top_share: float = 0.5) -> DataFrame:
    """Add the crops of the upper (left person) and lower panel."""
    def face(s: str) -> Column:
        return F.struct(F.col(f"{s}x").alias("x"), F.col(f"{s}y").alias("y"), F.col(f"{s}w").alias("w"),
                        F.col(f"{s}h").alias("h"))

    sep = F.abs(F.col("rx") - F.col("lx"))
    return faces.withColumn("top", panel_rect(face("l"), sep, top_share, f)).withColumn(
        "bottom", panel_rect(face("r"), sep, 1.0 - top_share, f))


def shot_panels(pair_rows: DataFrame, shots: DataFrame, f: Frame) -> DataFrame:
    """Panels per shot ``(video_id, shot_frame)``: its own with three sightings, else the previous
    shot's, the next one's, the whole video's. Videos without a sighting are absent."""
    tagged = asof(pair_rows, shots, ["video_id"], "frame", "shot_frame", ["shot_frame"], "backward", [], 4096)
    counts = tagged.groupBy("video_id", "shot_frame").agg(F.count("*").alias("n"))
    own = with_panels(typical_faces(tagged, ["video_id", "shot_frame"]), f).join(counts, ["video_id", "shot_frame"])
    own = own.filter("n >= 3").select("video_id", "shot_frame", F.struct("top", "bottom").alias("own"))
    whole = with_panels(typical_faces(pair_rows, ["video_id"]), f).select(
        "video_id", F.struct("top", "bottom").alias("whole"))
    per = shots.join(own, ["video_id", "shot_frame"], "left")
    per = running(per, ["video_id"], ["shot_frame"], chunk_of("shot_frame", 4096), {
        "before": Scan("last", F.col("own")), "after": Scan("first", F.col("own"))})
    return per.join(whole, "video_id").select(
        "video_id", "shot_frame", F.coalesce("own", "before", "after", "whole").alias("p")).select(
        "video_id", "shot_frame", "p.top", "p.bottom")


def pair_share(frames: DataFrame, pair_rows: DataFrame) -> DataFrame:
    """Share of samples with a pair, and whether a tall canvas splits on it."""
    n = frames.groupBy("video_id").agg(F.count("*").alias("samples"))
    d = pair_rows.groupBy("video_id").agg(F.count("*").alias("pairs"))
    out = n.join(d, "video_id", "left").withColumn("pairs", F.coalesce("pairs", F.lit(0).cast("long")))
    auto = (F.col("pairs") >= 10) & (F.col("pairs") / F.col("samples") >= 0.6)
    return out.withColumn("split_auto", auto).withColumn("split_forced", F.col("pairs") >= 3)


def recall_report(frames: DataFrame, faces: DataFrame, frame_w: float) -> DataFrame:
    per = faces.groupBy("video_id", "frame").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("box.w") < 0.06 * frame_w, 1).otherwise(0)).alias("small"))
    return frames.join(per, ["video_id", "frame"], "left").groupBy("video_id").agg(
        F.count("*").alias("frames"), F.round(100.0 * F.count("n") / F.count("*"), 6).alias("recall_pct"),
        F.round(F.sum(F.coalesce("n", F.lit(0))) / F.count("*"), 6).alias("faces_per_frame"),
        F.coalesce(F.sum("small"), F.lit(0)).alias("small"))


def majority_vote(flags: DataFrame, reach: int = 2) -> DataFrame:
    """Smooth per-sample flags ``(video_id, i, face)``: true when at least half the samples within
    ``reach`` are."""
    def vote(w):
        frame = w.rowsBetween(-reach, reach)
        yes = F.sum(F.when(F.col("face"), 1).otherwise(0)).over(frame)
        return yes * 2 >= F.count("*").over(frame)

    return sliding(flags, ["video_id"], "i", reach, {"voted": vote})


def runs(flags: DataFrame, flag: str, extra: list[str] = ()) -> DataFrame:
    """Runs of equal ``flag`` along ``i``: first and last sample of each."""
    prev = running(flags, ["video_id"], ["i"], chunk_of("i", 4096), {"was": Scan("last", F.col(flag))})
    opens = F.when(F.col("was").isNull() | (F.col("was") != F.col(flag)), F.col("i"))
    tagged = running(prev.withColumn("__o", opens), ["video_id"], ["i"], chunk_of("i", 4096),
                     {"run": Scan("max", F.col("__o"), inclusive=True)})
    return tagged.groupBy("video_id", F.col("run").alias("i0"), flag).agg(
        F.max("i").alias("i1"), F.count("*").alias("n"), F.min("t_ms").alias("t0_ms"), F.max("t_ms").alias("t1_ms"))


def group_runs(frames: DataFrame, min_ms: int = 800) -> DataFrame:
    """Stretches with two or more faces that end (a sample with fewer follows) after 0.8 s."""
    r = runs(frames.withColumn("group", F.col("n_faces") >= 2), "group")
    nxt = running(r, ["video_id"], ["i0"], chunk_of("i0", 4096), {"end_ms": Scan("first", F.col("t0_ms"))})
    return nxt.filter(F.col("group") & (F.col("end_ms") - F.col("t0_ms") >= min_ms)).select(
        "video_id", F.col("t0_ms").alias("start_ms"), "end_ms")


def since_last_true(flags: DataFrame, flag: str, memory: int = 30, reset: str | None = None) -> DataFrame:
    """A memory set to ``memory`` samples while the flag holds, counting down after: alive or not. A sample
    where ``reset`` holds (a shot) clears what came before it."""
    scans = {"at": Scan("max", F.when(F.col(flag), F.col("i")), inclusive=True)}
    if reset is not None:
        scans["since"] = Scan("max", F.when(F.col(reset), F.col("i")), inclusive=True)
    last = running(flags, ["video_id"], ["i"], chunk_of("i", 4096), scans)
    left = F.greatest(memory - (F.col("i") - F.col("at")), F.lit(0))
    if reset is not None:
        left = F.when(F.col("since").isNull() | (F.col("at") >= F.col("since")), left)
    return last.withColumn("left", F.coalesce(left, F.lit(0).cast("long"))).drop("at", "since")


# Pixels ------------------------------------------------------------------------------------------

def average_hash(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """64-bit hash of each frame: a bit per 8x8 block brighter than the mean block."""
    cell = F.expr(f"(y * 8 div {height}) * 8 + (x * 8 div {width})").cast("int")
    cells = pixels.groupBy("video_id", "frame", cell.alias("cell")).agg(F.expr("sum(luma) div count(*)").alias("m"))
    mean = cells.groupBy("video_id", "frame").agg(F.expr("sum(m) div 64").alias("avg"))
    bit = F.when(F.col("m") > F.col("avg"), F.expr("shiftleft(1L, cell)")).otherwise(F.lit(0).cast("long"))
    return cells.join(mean, ["video_id", "frame"]).groupBy("video_id", "frame").agg(F.bit_or(bit).alias("hash"))


def frame_changes(pixels: DataFrame) -> DataFrame:
    """Mean absolute difference and 16-bin histogram turnover of each frame to the next."""
    nxt = pixels.select("video_id", (F.col("frame") - 1).alias("frame"), "y", "x", F.col("luma").alias("next"))
    diff = pixels.join(nxt, ["video_id", "frame", "y", "x"]).groupBy("video_id", "frame").agg(
        F.avg(F.abs(F.col("luma") - F.col("next"))).alias("diff"))
    bins = pixels.groupBy("video_id", "frame", F.expr("luma div 16").alias("bin")).agg(F.count("*").alias("c"))
    size = bins.groupBy("video_id", "frame").agg(F.sum("c").alias("n"))
    share = bins.join(size, ["video_id", "frame"]).select("video_id", "frame", "bin", (F.col("c") / F.col("n")).alias("p"))
    signed = share.unionByName(share.select(
        "video_id", (F.col("frame") - 1).alias("frame"), "bin", (-F.col("p")).alias("p")))
    turn = signed.groupBy("video_id", "frame", "bin").agg(F.sum("p").alias("d")).groupBy("video_id", "frame").agg(
        F.sum(F.abs("d")).alias("turnover"))
    return diff.join(turn, ["video_id", "frame"])


def mouth_motion(pixels: DataFrame, faces: DataFrame, channels: tuple[str, ...] = ("luma",)) -> DataFrame:
    """Motion of each face's mouth band against the frame before over all ``channels``, 0 to 1.

    A face that overlaps no face of the frame before (IoU over 0.35), has no frame before or an empty band has 0.
    """
    earlier = faces.select("video_id", (F.col("frame") + 1).alias("frame"), F.col("box").alias("was_box"))
    stays = faces.join(earlier, ["video_id", "frame"]).filter(iou("box", "was_box") > 0.35).select("video_id", "frame", "det").distinct()
    band = faces.join(stays, ["video_id", "frame", "det"], "left_semi").select(
        "video_id", "frame", "det",
        F.floor(F.greatest(F.col("box.x") + F.col("box.w") * 0.25, F.lit(0.0))).alias("x0"),
        F.floor(F.greatest(F.col("box.x") + F.col("box.w") * 0.75, F.lit(0.0))).alias("x1"),
        F.floor(F.greatest(F.col("box.y") + F.col("box.h") * 0.55, F.lit(0.0))).alias("y0"),
        F.floor(F.greatest(F.col("box.y") + F.col("box.h") * 0.92, F.lit(0.0))).alias("y1"))
    prev = pixels.select("video_id", (F.col("frame") + 1).alias("frame"), "y", "x", *[F.col(c).alias(f"was_{c}") for c in channels])
    change = sum((F.abs(F.col(c) - F.col(f"was_{c}")) for c in channels), F.lit(0)) / len(channels)
    moved = pixels.join(prev, ["video_id", "frame", "y", "x"]).withColumn("d", change)
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    hit = moved.join(band, ["video_id", "frame"]).filter(inside)
    found = hit.groupBy("video_id", "frame", "det").agg(F.least(F.avg("d") / 255.0 * 8.0, F.lit(1.0)).alias("motion"))
    return faces.select("video_id", "frame", "det").join(found, ["video_id", "frame", "det"], "left").withColumn(
        "motion", F.coalesce("motion", F.lit(0.0)))


def classify_cuts(changes: DataFrame, key: list[str], lo: Column, hi: Column) -> DataFrame:
    """Cut test per profile ``(key, i, t_ms, diff, turnover)``: the largest change inside
    ``[lo, hi]`` is a cut when it is at least 6 and either 2.5 times the upper median of the other
    real changes or a histogram turnover of 0.6. Profiles are tens of frames."""
    peak = changes.filter(F.col("t_ms").between(lo, hi) & (F.col("diff") > 0)).groupBy(*key).agg(
        F.max_by(F.struct("i", "t_ms", "diff", "turnover"), F.struct("diff", -F.col("i"))).alias("p"))
    peak = peak.filter("p.diff >= 6")
    others = changes.join(peak.select(*key, F.col("p.i").alias("pi")), key).filter(
        (F.abs(F.col("i") - F.col("pi")) > 1) & (F.col("diff") > 0.5))
    motion = others.groupBy(*key).agg(upper_median("diff").alias("motion"))
    out = peak.join(motion, key, "left").withColumn("motion", F.coalesce("motion", F.lit(0.0)))
    return out.filter((F.col("p.diff") >= 2.5 * F.col("motion")) | (F.col("p.turnover") >= 0.6)).select(
        *key, F.col("p.t_ms").alias("cut_ms"))

"""Image signatures, their similarity, and decisions between candidates."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import box_overlap, fixed_decimals, round_half_up
from ..functions.text import ocr_line
from . import matching
from .matching import nearest_descriptors  # noqa: F401  (callers look for it here)
from .ordering import top_per_key

#: Cells, coefficients and limits of a signature and of decisions.
READ_CHARS = 10_000  # of a recognised text
GRID, COEFFICIENTS, COLOUR_GRID = 16, 8, 4
LEAST_DEVIATION = 7.0
LEAST_SCORE = 0.72
HASH_WEIGHT, COLOUR_WEIGHT = 0.78, 0.22
#: Window widths: the least, their growth, and the strides and reaches of the search as shares of a window.
LEAST_WIDTH, LEAST_SHARE, GROWTH, ASPECT_STEP, OWN_ASPECT = 48, 0.07, 1.32, 1.13, 0.16
STRIDE, REACH, LEAST_STRIDE = 0.26, 0.13, 10
LEADERS = 12
#: Least scores of a match: found by keypoints; by signature, with and without keypoints available.
THRESHOLDS = (0.89, 0.96, 0.88)
SIGNATURE = "hash bigint, color array<float>, deviation double"


def reduce_pixels(pixels: np.ndarray, most: int) -> np.ndarray:
    """Nearest-neighbour reduction so that no side is longer than ``most``."""
    height, width = pixels.shape[:2]
    scale = min(1.0, most / max(height, width))
    if scale == 1.0:
        return pixels
    h, w = max(1, int(height * scale + 0.5)), max(1, int(width * scale + 0.5))
    return pixels[np.minimum(height - 1, np.arange(h) * height // h)[:, None], np.minimum(width - 1, np.arange(w) * width // w)]


def integral_images(pixels: np.ndarray) -> np.ndarray:
    """Prefix sums of red, green, blue and integer luma, with a zero row and column in front."""
    rgb = pixels[..., :3].astype(np.int64)
    luma = (77 * rgb[..., 0] + 150 * rgb[..., 1] + 29 * rgb[..., 2]) >> 8
    out = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1, 4), np.int64)
    out[1:, 1:] = np.concatenate([rgb, luma[..., None]], axis=2).cumsum(axis=0).cumsum(axis=1)
    return out


def _cell_means(sums: np.ndarray, boxes: np.ndarray, cells: int, channels: slice) -> np.ndarray:
    """Means over the cells of boxes (x, y, width, height): boxes x cells x cells x channels."""
    x, y, width, height = (boxes[:, k, None] for k in range(4))
    k = np.arange(cells)

    def edges(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin = k * side // cells
        return begin, np.maximum((k + 1) * side // cells, begin + 1)

    (y0, y1), (x0, x1) = edges(height), edges(width)
    corner = lambda r, c: sums[(y + r)[:, :, None], (x + c)[:, None, :], channels]
    total = corner(y1, x1) - corner(y0, x1) - corner(y1, x0) + corner(y0, x0)
    return total / ((y1 - y0)[:, :, None] * (x1 - x0)[:, None, :])[..., None]


_ANGLES = np.cos((2 * np.arange(GRID)[None, :] + 1) * np.arange(COEFFICIENTS)[:, None] * np.pi / (2 * GRID))


def box_signatures(sums: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each box: 63 flags (cosine coefficients above their median, the constant one left out), 4x4 colour means, luma deviation."""
    luma = _cell_means(sums, boxes, GRID, slice(3, 4))[..., 0]
    coefficients = (_ANGLES @ luma @ _ANGLES.T).reshape(len(boxes), -1)[:, 1:]
    median = np.sort(coefficients, axis=1)[:, coefficients.shape[1] // 2, None]
    colour = _cell_means(sums, boxes, COLOUR_GRID, slice(0, 3)).astype(np.float32).reshape(len(boxes), -1)
    spread = (luma**2).mean(axis=(1, 2)) - luma.mean(axis=(1, 2)) ** 2
    return coefficients > median, colour, np.sqrt(np.maximum(0.0, spread))


def _number(flags: np.ndarray) -> int:
    return sum(1 << int(i) for i in np.flatnonzero(flags))


def signature(sums: np.ndarray, x: int, y: int, width: int, height: int) -> tuple[int, list[float], float]:
    """The signature of one box: its flags as a number, colours and deviation."""
    flags, colour, deviation = box_signatures(sums, np.array([[x, y, width, height]]))
    return _number(flags[0]), colour[0].tolist(), float(deviation[0])


def _decoded(width: int, height: int, rgba: bytes, most: int) -> np.ndarray | None:
    if not width or not height or rgba is None or len(rgba) != width * height * 4 or min(width, height) < 16:
        return None
    pixels = reduce_pixels(np.frombuffer(rgba, np.uint8).reshape(height, width, 4), most)
    return pixels if min(pixels.shape[:2]) >= 16 else None


def signatures(images: DataFrame, most: int = 480) -> DataFrame:
    """Add ``signature`` to rows (width, height, rgba); null where the buffer is no image of at least 16 by 16."""

    @F.pandas_udf(SIGNATURE)
    def made(width: pd.Series, height: pd.Series, rgba: pd.Series) -> pd.DataFrame:
        rows = []
        for w, h, data in zip(width, height, rgba, strict=True):
            pixels = None if pd.isna(w) or pd.isna(h) else _decoded(int(w), int(h), data, most)
            rows.append((None, None, None) if pixels is None else signature(integral_images(pixels), 0, 0, pixels.shape[1], pixels.shape[0]))
        out = pd.DataFrame(rows, columns=["hash", "color", "deviation"])
        return out.assign(hash=out["hash"].astype("Int64"))

    return images.withColumn("signature", made("width", "height", "rgba"))


def usable(references: DataFrame) -> DataFrame:
    """References with a signature that is not nearly flat."""
    return references.where(F.col("signature.deviation") >= LEAST_DEVIATION)


def median_hash(values: Column, skip: int = 1) -> Column:
    """63 bits of an array: which of the values after the first ``skip`` are above their middle one.

    The array is sorted once: inside ``transform`` the middle one would be looked for again for every value.
    """
    rest = F.slice(values, skip + 1, 63)
    middle = F.element_at(F.array_sort(rest), F.floor(F.size(rest) / 2).cast("int") + 1)

    def number(b: Column) -> Column:
        flags = F.transform(b["rest"], lambda v, i: F.when(v > b["middle"], F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(flags, F.lit(0).cast("long"), lambda acc, bit: acc.bitwiseOR(bit))

    return F.get(F.transform(F.array(F.struct(rest.alias("rest"), middle.alias("middle"))), number), F.lit(0))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def colour_nearness(a: Column, b: Column) -> Column:
    """1 for equal colour means, 0 for the farthest."""
    apart = F.aggregate(F.zip_with(a["color"], b["color"], lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda acc, d: acc + d)
    return 1 - apart / (F.size(a["color"]) * 255.0)


def similarity(a: Column, b: Column) -> Column:
    """0.78 of equal hash bits and 0.22 of colour nearness."""
    return HASH_WEIGHT * (1 - hamming(a["hash"], b["hash"]) / 63.0) + COLOUR_WEIGHT * colour_nearness(a, b)


def reach(floor: float) -> int:
    """The most hash bits in which a pair of equal colours may differ and still score above the floor; -1: none."""
    return max((d for d in range(matching.HASH_BITS + 1) if HASH_WEIGHT * (1 - d / 63.0) + COLOUR_WEIGHT > floor), default=-1)


def compare(candidates: DataFrame, references: DataFrame, floor: float = LEAST_SCORE) -> DataFrame:
    """Scores above the floor of candidate windows and references in the same aspect bucket.

    The floor is a Hamming radius of the hashes, so only pairs that an index of
    hash blocks lets meet are scored. The reference's columns are named ``ref_...``.
    """
    asked = candidates.withColumn("q_hash", F.col("signature.hash"))
    known = references.select(F.col("aspect_bucket"), *[F.col(c).alias(f"ref_{c}") for c in references.columns if c != "aspect_bucket"], F.col("signature.hash").alias("hash"))
    near = matching.within_hamming(asked, known, reach(floor), ["aspect_bucket"]).drop("q_hash", "hash", "distance")
    return near.withColumn("score", similarity(F.col("signature"), F.col("ref_signature"))).where(F.col("score") > floor)


def best_windows(windows: DataFrame, references: DataFrame) -> DataFrame:
    """The best window (case, x, y, width, height, seen) of each reference (ordinal) in each case, the first seen of equal ones.

    Hashes are compared first: colours are only looked at where, equal, they could
    lift a window above the best hash of its reference.
    """
    c, r = windows.alias("c"), references.alias("r")
    by_hash = HASH_WEIGHT * (1 - hamming(F.col("c.signature.hash"), F.col("r.signature.hash")) / 63.0)
    met = c.join(r, F.col("c.aspect_bucket") == F.col("r.aspect_bucket")).withColumn("by_hash", by_hash)
    least = met.groupBy("case", "ordinal").agg(F.max("by_hash").alias("least"))
    open_ones = met.join(least, ["case", "ordinal"]).where(F.col("by_hash") + COLOUR_WEIGHT >= F.col("least") - 1e-12)
    scored = open_ones.select(
        "case", "ordinal", "heroId", "variantId", F.col("r.aspect_bucket").alias("aspect_bucket"), F.col("r.aspect").alias("aspect"), F.col("r.signature").alias("signature"),
        "seen", F.struct("x", "y", F.col("c.width").alias("width"), F.col("c.height").alias("height")).alias("box"), similarity(F.col("c.signature"), F.col("r.signature")).alias("score"),
        hamming(F.col("c.signature.hash"), F.col("r.signature.hash")).cast("int").alias("hashDistance"), colour_nearness(F.col("c.signature"), F.col("r.signature")).alias("colorScore"),
    )
    kept = F.max_by(F.struct("heroId", "variantId", "aspect_bucket", "aspect", "signature", "box", "score", "hashDistance", "colorScore"), F.struct("score", -F.col("seen")))
    return scored.where("score > 0").groupBy("case", "ordinal").agg(kept.alias("b")).select("case", "ordinal", "b.*")


def window_sizes(width: int, height: int, aspect: float) -> list[tuple[int, int]]:
    """Window sizes (width, height) of one aspect, ascending and each once.

    Widths grow by ``GROWTH``, rounded at each step, from the least useful width
    to the widest that fits; the widest is always there, and the whole image's
    width where the image has nearly that aspect itself.
    """
    widest = int(min(width, height * aspect))
    smallest = max(LEAST_WIDTH, int(np.ceil(LEAST_WIDTH * aspect)), int(min(width, height) * LEAST_SHARE))
    widths = set()
    if smallest <= widest:
        widths.add(widest)
        w = smallest
        while w < widest:
            widths.add(w)
            w = max(w + 1, int(w * GROWTH + 0.5))
    if abs(width / height - aspect) < OWN_ASPECT * aspect:
        widths.add(width)
    w = np.array(sorted(widths), np.int64)
    h = np.minimum(height, np.floor(w / aspect + 0.5).astype(np.int64))
    kept = (w >= 16) & (h >= 16)
    return [(int(a), int(b)) for a, b in zip(w[kept], h[kept], strict=True)]


def _starts(span: int, window: int, step: int) -> list[int]:
    return [*range(0, span - window, step), span - window] if span > window else [0]


_SIGNATURE_TYPE = f"struct<{SIGNATURE.replace(' bigint', ':bigint').replace(' array', ':array').replace(' double', ':double')}>"


def scan_windows(images: DataFrame, aspect_buckets: list[int], most: int = 960) -> DataFrame:
    """Signatures of all windows of an image (id, width, height, rgba) in the given aspects; flat ones are left out.

    ``seen`` numbers an image's windows in the order of the scan.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                pixels = _decoded(int(row.width), int(row.height), row.rgba, most)
                if pixels is None:
                    continue
                sums, (h, w) = integral_images(pixels), pixels.shape[:2]
                out, seen = [], 0
                for bucket in aspect_buckets:
                    for ww, wh in window_sizes(w, h, ASPECT_STEP**bucket):
                        step = lambda side: max(LEAST_STRIDE, int(side * STRIDE + 0.5))
                        boxes = np.array([(x, y, ww, wh) for y, x in product(_starts(h, wh, step(wh)), _starts(w, ww, step(ww)))])
                        flags, colours, deviation = box_signatures(sums, boxes)
                        for k in np.flatnonzero(deviation >= LEAST_DEVIATION):
                            made = {"hash": _number(flags[k]), "color": colours[k].tolist(), "deviation": float(deviation[k])}
                            out.append((row.id, bucket, seen + int(k) + 1, *(int(v) for v in boxes[k]), made))
                        seen += len(boxes)
                yield pd.DataFrame(out, columns=["id", "aspect_bucket", "seen", "x", "y", "width", "height", "signature"])

    return images.select("id", "width", "height", "rgba").where("width IS NOT NULL AND height IS NOT NULL").mapInPandas(
        scan, f"id string, aspect_bucket int, seen int, x int, y int, width int, height int, signature {_SIGNATURE_TYPE}"
    )


def leaders(best: DataFrame, count: int = LEADERS) -> DataFrame:
    """The references of each case and aspect bucket with the best windows; ties in input order."""
    return top_per_key(best, ["case", "aspect_bucket"], count, F.desc("score"), "ordinal").drop("rank")


def _likeness(flags: np.ndarray, colours: np.ndarray, reference) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``similarity`` of the signatures of boxes to one reference's, the hash bits that differ and the colour nearness."""
    wanted = np.array([int(reference["hash"]) >> k & 1 for k in range(matching.HASH_BITS)], bool)
    apart = np.abs(colours.astype(np.float64) - np.asarray(reference["color"], np.float64)).sum(axis=1)
    bits, near = (flags != wanted).sum(axis=1), 1 - apart / (colours.shape[1] * 255.0)
    return HASH_WEIGHT * (1 - bits / 63.0) + COLOUR_WEIGHT * near, bits, near


def _places(at: int, by: int, step: int, side: int, span: int) -> np.ndarray:
    """Starts within ``by`` of ``at`` that keep a window of ``side`` inside ``span``."""
    return np.arange(max(0, at - by), min(span - side, at + by) + 1, step)


def _moved(box: tuple, by: tuple[int, int], step: int, shape: tuple[int, int]) -> np.ndarray:
    """The box moved to all places within reach, row by row."""
    x, y, width, height = box
    ys, xs = np.meshgrid(_places(y, by[1], step, height, shape[0]), _places(x, by[0], step, width, shape[1]), indexing="ij")
    return np.stack([xs.ravel(), ys.ravel(), np.full(xs.size, width), np.full(xs.size, height)], axis=1)


def _settle(sums: np.ndarray, lead, shape: tuple[int, int]) -> tuple[float, tuple[int, int, int, int], int, float]:
    """A reference's best window near its coarse one: moved by up to ``REACH``, then resized and moved by a few pixels.

    All boxes of a step are judged at once; the first of the best ones stays, and none that is not better than before.
    Gives its score, box, differing hash bits and colour nearness.
    """
    best, at = lead["score"], tuple(lead["box"][k] for k in ("x", "y", "width", "height"))
    bits, near = lead["hashDistance"], lead["colorScore"]

    def better(boxes: np.ndarray) -> None:
        nonlocal best, at, bits, near
        if len(boxes):
            flags, colours, deviation = box_signatures(sums, boxes)
            scores, apart, alike = _likeness(flags, colours, lead["signature"])
            scores = np.where(deviation >= LEAST_DEVIATION, scores, -np.inf)
            top = int(np.argmax(scores))
            if scores[top] > best:
                best, at = float(scores[top]), tuple(int(v) for v in boxes[top])
                bits, near = int(apart[top]), float(alike[top])

    better(_moved(at, (int(at[2] * REACH + 0.5), int(at[3] * REACH + 0.5)), 2, shape))
    x, y, width, _ = at
    sizes = [(w, int(w / lead["aspect"] + 0.5)) for w in range(max(16, width - 3), min(shape[1], width + 3) + 1)]
    moved = [_moved((x, y, w, h), (2, 2), 1, shape) for w, h in sizes if 16 <= h <= shape[0]]
    if moved:
        better(np.concatenate(moved))
    return best, at, bits, near


def refine(images: DataFrame, led: DataFrame, most: int = 960) -> DataFrame:
    """(case, ordinal, score, box, hashDistance, colorScore) of the leaders after a search at the precision of pixels, so that a small card between strides is found.

    An image meets at most ``LEADERS`` references for each aspect bucket.
    """
    given = led.groupBy(F.col("case").alias("id")).agg(F.collect_list(F.struct("ordinal", "aspect", "signature", "box", "score", "hashDistance", "colorScore")).alias("led"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                pixels = _decoded(int(row.width), int(row.height), row.rgba, most)
                if pixels is None:
                    continue
                sums = integral_images(pixels)
                out = [(row.id, lead["ordinal"], *_settle(sums, lead, pixels.shape[:2])) for lead in row.led]
                boxes = [dict(zip(("x", "y", "width", "height"), o[3], strict=True)) for o in out]
                yield pd.DataFrame({"case": [o[0] for o in out], "ordinal": [o[1] for o in out], "score": [o[2] for o in out], "box": boxes, "hashDistance": [o[4] for o in out], "colorScore": [o[5] for o in out]})

    return images.select("id", "width", "height", "rgba").join(given, "id").mapInPandas(search, "case string, ordinal long, score double, box struct<x:int,y:int,width:int,height:int>, hashDistance int, colorScore double")


def scaled_box(box: Column, from_width: Column, to_width: Column, from_height: Column, to_height: Column) -> Column:
    """A box in another resolution, whole pixels."""
    sx, sy = to_width / from_width, to_height / from_height
    return F.struct(*[round_half_up(box[k] * s).cast("int").alias(k) for k, s in (("x", sx), ("y", sy), ("width", sx), ("height", sy))])


def project(matrix: Column, x: Column, y: Column) -> Column:
    """A point through a 3x3 homography given as nine numbers."""
    m = lambda i: F.element_at(matrix, i)
    w = m(7) * x + m(8) * y + m(9)
    return F.struct((F.try_divide(m(1) * x + m(2) * y + m(3), w)).alias("x"), (F.try_divide(m(4) * x + m(5) * y + m(6), w)).alias("y"))


def bounding_box(points: DataFrame, keys: list[str]) -> DataFrame:
    return points.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x")).alias("width"), (F.max("y") - F.min("y")).alias("height"))


def enough_inliers(inliers: Column, matches: Column, least: int = 12, share: float = 0.55) -> Column:
    return F.coalesce((inliers >= least) & (F.try_divide(inliers, matches) >= share), F.lit(False))


def best_per_hero(candidates: DataFrame, keys: list[str], *carried: str) -> DataFrame:
    """Best variant of each hero in input order: a raw score replaces the kept one if above its value rounded to four places.

    ``ordinal`` is that of the hero's first candidate; ``carried`` columns are those of its best one.
    """
    kept = ["score", "variantId", *carried]
    none = F.struct(*[F.lit(None).cast(candidates.schema[c].dataType).alias(c) for c in kept])
    fold = F.aggregate(
        F.array_sort(F.collect_list(F.struct("ordinal", *kept))),
        none,
        lambda acc, x: F.when(
            acc["score"].isNull() | (x["score"] > acc["score"]),
            F.struct(fixed_decimals(x["score"], 4).alias("score"), *[x[c].alias(c) for c in kept[1:]]),
        ).otherwise(acc),
    )
    return candidates.groupBy(*keys, "heroId").agg(fold.alias("b"), F.min("ordinal").alias("ordinal")).select(*keys, "heroId", "ordinal", "b.*")


def decide(
    best: DataFrame, keys: list[str], orb_available: bool = False, floor: float = LEAST_SCORE,
    thresholds: tuple[float, float, float] = THRESHOLDS, margins: tuple[float, float] = (0.045, 0.06), most: int = 3,
) -> DataFrame:
    """Status and up to ``most`` matches of each case from its heroes' best scores (heroId, score, method; ordinal, box,
    evidence, hashDistance, colorScore).

    Equal scores keep the order of ``ordinal``; without such a column the higher
    hero id is first. The margin is taken before the floor is applied: a runner-up
    below it still counts. Thresholds: of keypoints, with and without keypoints
    available; margins: usual, and where keypoints were available but not used.
    """
    shown = F.struct("score", "heroId", "method", *[c for c in ("box", "evidence", "hashDistance", "colorScore") if c in best.columns])
    if "ordinal" in best.columns:
        in_order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("below"), "ordinal", shown.alias("m"))))
    else:
        in_order = F.sort_array(F.collect_list(F.struct("score", "heroId", shown.alias("m"))), asc=False)
    cases = best.groupBy(*keys).agg(F.transform(in_order, lambda x: x["m"]).alias("all"))
    first, second = F.try_element_at("all", F.lit(1)), F.try_element_at("all", F.lit(2))
    by_orb = first["method"] == "orb"
    threshold = F.when(by_orb, thresholds[0]).otherwise(thresholds[1] if orb_available else thresholds[2])
    margin = F.when(F.lit(orb_available) & ~by_orb, margins[1]).otherwise(margins[0])
    sure = F.coalesce((first["score"] >= threshold) & (second.isNull() | (first["score"] - second["score"] >= margin)), F.lit(False))
    return cases.select(
        *keys,
        F.when(sure, "match").otherwise("uncertain").alias("status"),
        F.slice(F.filter("all", lambda m: m["score"] >= floor), 1, most).alias("matches"),
        F.when(sure, "confident_match").otherwise("insufficient_evidence").alias("reason"),
    )


def tie_eligible(status: Column, matches: Column, orb_available: Column, most_gap: float = 0.045, thresholds: tuple[float, float, float] = THRESHOLDS) -> Column:
    """Two strong candidates too close to call; ``thresholds`` as in ``decide``."""
    first, second = F.try_element_at(matches, F.lit(1)), F.try_element_at(matches, F.lit(2))
    threshold = lambda m: F.when(m["evidence"]["method"] == "orb", thresholds[0]).when(F.coalesce(orb_available, F.lit(True)), thresholds[1]).otherwise(thresholds[2])
    return F.coalesce(
        (status == "uncertain")
        & (first["score"] >= second["score"])
        & (first["score"] >= threshold(first))
        & (second["score"] >= threshold(second))
        & (first["score"] - second["score"] <= most_gap),
        F.lit(False),
    )


def ocr_box(matches: Column, least_overlap: float = 0.5) -> Column:
    """Where to read the name of two tied candidates: around both boxes, with room below; null if they lie apart."""
    a, b = F.try_element_at(matches, F.lit(1))["box"], F.try_element_at(matches, F.lit(2))["box"]
    sound = lambda box: (box["x"] >= 0) & (box["y"] >= 0) & (box["width"] > 0) & (box["height"] > 0)
    left, top = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    width = F.greatest(a["x"] + a["width"], b["x"] + b["width"]) - left
    height = F.greatest(a["y"] + a["height"], b["y"] + b["height"]) - top
    crop = F.struct(
        F.greatest(F.lit(0), F.floor(left - width * 0.08)).alias("x"),
        F.greatest(F.lit(0), F.floor(top - height * 0.08)).alias("y"),
        F.ceil(width + 2 * (width * 0.08)).alias("width"),
        F.ceil(height + height * 0.08 + height * 0.35).alias("height"),
    )
    return F.when(sound(a) & sound(b) & (box_overlap(a, b) >= least_overlap), crop)


def clamped_confidence(x: Column) -> Column:
    """A reader's confidence within 0 and 100; 0 for none and for what is no number."""
    number = x.cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
    return F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(100.0), number))).otherwise(0.0)


def named_candidate(ocr: DataFrame, candidates: DataFrame, least_confidence: float = 35.0) -> DataFrame:
    """(case, heroId, matched, confidence): the one hero whose whole name stands in a line; none or several give no row.

    ``ocr``: case, status, text, confidence. ``candidates``: case, heroId, name, aliases.
    """
    sure = ocr.withColumn("confidence", clamped_confidence(F.col("confidence"))).where((F.col("status") == "ok") & (F.col("confidence") >= least_confidence))
    lines = sure.select("case", "confidence", F.explode(F.split(F.left(F.coalesce("text", F.lit("")), F.lit(READ_CHARS)), "\r?\n")).alias("line")).select("case", "confidence", ocr_line(F.col("line")).alias("line")).where("line <> ''")
    names = candidates.where("heroId IS NOT NULL").select(
        "case", "heroId", F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("at", "name")
    )
    names = names.select("case", "heroId", "at", ocr_line(F.col("name")).alias("name")).where(F.char_length("name") >= 2)
    hits = names.join(lines, "case").where(F.contains("line", "name")).groupBy("case", "heroId").agg(F.min_by("name", "at").alias("matched"), F.max("confidence").alias("confidence"))
    only = hits.groupBy("case").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("heroId", "matched", "confidence")])
    return only.where("n = 1").drop("n")


def break_ties(results: DataFrame, hits: DataFrame) -> DataFrame:
    """Promote the named one of the first two candidates of an eligible case; scores stay as they are.

    Every match gets ``visualScore``, ``visualRank`` and ``ocr`` (method, matchedName,
    confidence): what it was by sight and what was read, for the promoted one, else null.
    """
    read = [F.col(c).cast(t).alias(f"_{c}") if c in hits.columns else F.lit(None).cast(t).alias(f"_{c}") for c, t in (("matched", "string"), ("confidence", "double"))]
    joined = results.join(hits.select("case", F.col("heroId").alias("_hit"), *read), "case", "left")
    at = F.array_position(F.transform(F.slice("matches", 1, 2), lambda m: m["heroId"]), F.col("_hit"))
    promote = F.coalesce((at > 0) & tie_eligible(F.col("status"), F.col("matches"), F.col("orb_available")) & ocr_box(F.col("matches")).isNotNull(), F.lit(False))
    reading = F.struct(F.lit("ocr_name").alias("method"), F.col("_matched").alias("matchedName"), F.col("_confidence").alias("confidence"))

    def told(m: Column, i: Column) -> Column:
        chosen = F.col("_go") & (i == at - 1)
        rank = (i + 1).cast("int")
        return m.withField("visualScore", F.when(chosen, m["score"])).withField("visualRank", F.when(chosen, rank)).withField("ocr", F.when(chosen, reading))

    moved = F.concat(F.array(F.element_at("matches", F.greatest(at, F.lit(1)).cast("int"))), F.filter("matches", lambda m, i: i != at - 1))
    return (
        joined.withColumn("_go", promote)
        .withColumn("matches", F.transform("matches", told))
        .withColumn("matches", F.when(F.col("_go"), moved).otherwise(F.col("matches")))
        .withColumn("status", F.when(F.col("_go"), "match").otherwise(F.col("status")))
        .withColumn("reason", F.when(F.col("_go"), "ocr_tiebreak").otherwise(F.col("reason")))
        .drop("_go", "_hit", "_matched", "_confidence")
    )

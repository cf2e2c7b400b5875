"""Matched keypoints of image pairs: homographies, their checks, and what they add to a coarse ranking.

Keypoints and descriptors are input; ``matching.nearest_descriptors`` pairs them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import fixed_decimals, polygon_area
from .ordering import top_per_key
from .vision import enough_inliers, project, scaled_box

#: Pixels within which a point agrees, pairs and spread needed, and bounds of the found outline.
WITHIN = 3.0
LEAST_PAIRS = 12
LEAST_SPREAD = 0.2
OUTSIDE, LEAST_AREA, MOST_AREA = 0.1, 0.0015, 0.9
REFERENCES = 32
#: Samples of four pairs that are tried.
TRIALS = 500


def _scaled(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points moved to their centre and scaled to a mean distance of sqrt 2, and the matrix that does so."""
    centre = points.mean(axis=0)
    size = np.sqrt(((points - centre) ** 2).sum(axis=1)).mean()
    scale = np.sqrt(2) / size if size > 0 else 1.0
    matrix = np.array([[scale, 0, -scale * centre[0]], [0, scale, -scale * centre[1]], [0, 0, 1]])
    return (points - centre) * scale, matrix


def direct_linear(source: np.ndarray, target: np.ndarray) -> np.ndarray | None:
    """The homography with least algebraic error from four or more pairs; None where they leave it open."""
    (a, first), (b, second) = _scaled(source), _scaled(target)
    ones, none = np.ones(len(a)), np.zeros((len(a), 3))
    homogeneous = np.column_stack([a, ones])
    rows = np.concatenate([np.column_stack([homogeneous, none, -b[:, :1] * homogeneous]), np.column_stack([none, homogeneous, -b[:, 1:] * homogeneous])])
    _, weights, directions = np.linalg.svd(rows)
    if len(weights) < 8 or weights[7] < 1e-9 * weights[0]:
        return None
    found = np.linalg.inv(second) @ directions[-1].reshape(3, 3) @ first
    return found / found[2, 2] if abs(found[2, 2]) > 1e-12 else None


def _agreeing(matrices: np.ndarray, source: np.ndarray, target: np.ndarray, within: float) -> np.ndarray:
    """For each matrix which pairs it maps to within some pixels."""
    mapped = np.column_stack([source, np.ones(len(source))]) @ np.swapaxes(matrices, -1, -2)
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = ((mapped[..., :2] / mapped[..., 2:] - target) ** 2).sum(axis=-1)
    return np.nan_to_num(apart, nan=np.inf) <= within**2


def sample_consensus(source: np.ndarray, target: np.ndarray, seed: int, within: float = WITHIN, trials: int = TRIALS) -> tuple[np.ndarray, np.ndarray] | None:
    """The homography that most pairs agree with, and which do: seeded samples of four pairs, all solved at once, then
    the fit to those that agree with the best. None for fewer than four pairs, or where no sample settles one."""
    n = len(source)
    if n < 4:
        return None
    chosen = np.argsort(np.random.default_rng(seed).random((trials, n)), axis=1)[:, :4]
    a, b = source[chosen], target[chosen]
    ones, none = np.ones((trials, 4, 1)), np.zeros((trials, 4, 3))
    homogeneous = np.concatenate([a, ones], axis=2)
    left = np.concatenate([np.concatenate([homogeneous, none, -b[..., :1] * a], axis=2), np.concatenate([none, homogeneous, -b[..., 1:] * a], axis=2)], axis=1)
    right = np.concatenate([b[..., :1], b[..., 1:]], axis=1)
    sound = np.linalg.cond(left) < 1e12
    if not sound.any():
        return None
    solved = np.linalg.solve(left[sound], right[sound])[..., 0]
    matrices = np.concatenate([solved, np.ones((len(solved), 1))], axis=1).reshape(-1, 3, 3)
    agree = _agreeing(matrices, source, target, within)
    best = int(np.argmax(agree.sum(axis=1)))
    matrix, inliers = matrices[best], agree[best]
    refined = direct_linear(source[inliers], target[inliers]) if inliers.sum() >= 4 else None
    if refined is not None and (again := _agreeing(refined, source, target, within)).sum() >= inliers.sum():
        matrix, inliers = refined, again
    return matrix, inliers


def homographies(pairs: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """(keys, matrix, inliers, pairs) of the image pairs whose points (from_x, from_y, to_x, to_y) settle a homography.

    The points of an image pair are as many as its keypoints, some hundreds; pairs
    of images are dealt to tasks. The same points in any order give the same
    matrix: samples are seeded by ``seed`` and the keys, and drawn from sorted points.
    """

    def fitted(names: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["from_x", "from_y", "to_x", "to_y"])
        points = rows[["from_x", "from_y", "to_x", "to_y"]].to_numpy(np.float64)
        found = sample_consensus(points[:, :2], points[:, 2:], xxhash.xxh32_intdigest(repr(names), seed))
        out = [(*names, found[0].ravel().tolist(), int(found[1].sum()), len(points))] if found else []
        return pd.DataFrame(out, columns=[*keys, "matrix", "inliers", "pairs"])

    types = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys)
    return pairs.groupBy(*keys).applyInPandas(fitted, f"{types}, matrix array<double>, inliers int, pairs int")


def verified(pairs: DataFrame, images: DataFrame, references: DataFrame, seed: int = 0) -> DataFrame:
    """(case, ordinal, score, box, inliers, correspondences, inlierRatio) of the references found by their keypoints.

    ``pairs``: case, ordinal and the points of a reference in an image. ``images``
    (case, width, height and the size w, h at which its points were taken) and
    ``references`` (ordinal, r_width, r_height) give the sizes. Found means: pairs
    enough and spread over the reference, a homography that most of them agree
    with, and a projected outline that lies in the image and has a fair area.
    """
    spread = pairs.groupBy("case", "ordinal").agg(F.count("*").alias("n"), (F.max("from_x") - F.min("from_x")).alias("wide"), (F.max("from_y") - F.min("from_y")).alias("high"))
    enough = spread.where(F.col("n") >= LEAST_PAIRS).join(F.broadcast(references), "ordinal")  # a pack's references: hundreds
    enough = enough.where((F.col("wide") >= F.col("r_width") * LEAST_SPREAD) & (F.col("high") >= F.col("r_height") * LEAST_SPREAD))
    found = homographies(pairs.join(enough.select("case", "ordinal"), ["case", "ordinal"], "left_semi"), ["case", "ordinal"], seed)
    found = found.where(enough_inliers(F.col("inliers"), F.col("pairs"))).join(F.broadcast(references), "ordinal").join(images, "case")
    corner = lambda x, y: project(F.col("matrix"), x, y)
    zero, right, low = F.lit(0.0), F.col("r_width").cast("double"), F.col("r_height").cast("double")
    found = found.withColumn("outline", F.array(corner(zero, zero), corner(right, zero), corner(right, low), corner(zero, low)))
    inside = F.forall("outline", lambda p: p["x"].between(-F.col("w") * OUTSIDE, F.col("w") * (1 + OUTSIDE)) & p["y"].between(-F.col("h") * OUTSIDE, F.col("h") * (1 + OUTSIDE)))
    area, whole = polygon_area(F.col("outline")), F.col("w") * F.col("h")
    found = found.where(F.coalesce(inside, F.lit(False)) & (area >= whole * LEAST_AREA) & (area <= whole * MOST_AREA))
    side = lambda c, pick: pick(F.transform("outline", lambda p: p[c]))
    x0, y0 = F.greatest(F.lit(0.0), side("x", F.array_min)), F.greatest(F.lit(0.0), side("y", F.array_min))
    x1, y1 = F.least(F.col("w").cast("double"), side("x", F.array_max)), F.least(F.col("h").cast("double"), side("y", F.array_max))
    box = F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("width"), (y1 - y0).alias("height"))
    ratio = F.col("inliers") / F.col("pairs")
    return found.select(
        "case", "ordinal",
        F.least(F.lit(0.99), 0.83 + 0.08 * F.least(F.lit(1.0), F.col("inliers") / 25) + 0.06 * ratio).alias("score"),
        scaled_box(box, F.col("w"), F.col("width"), F.col("h"), F.col("height")).alias("box"),
        "inliers", F.col("pairs").alias("correspondences"), fixed_decimals(ratio, 3).alias("inlierRatio"),
    )


def to_be_checked(coarse: DataFrame, count: int = REFERENCES) -> DataFrame:
    """The references (case, ordinal, score) of each case whose keypoints are looked at: the best, ties in input order."""
    return top_per_key(coarse, "case", count, F.desc("score"), "ordinal").drop("rank")


def with_keypoints(coarse: DataFrame, pairs_of: Callable[[DataFrame], DataFrame], images: DataFrame, references: DataFrame, count: int = REFERENCES) -> DataFrame:
    """A coarse ranking (case, ordinal, score, box, method) whose best ``count`` references of each case were looked at again.

    ``pairs_of`` gives the matched points of the (case, ordinal) it is asked for.
    A found reference has the keypoints' box and evidence in place of the coarse
    ones and the better of both scores; the others stay as they were.
    """
    found = verified(pairs_of(to_be_checked(coarse, count).select("case", "ordinal")), images, references)
    again = found.select("case", "ordinal", F.col("score").alias("_score"), F.col("box").alias("_box"), "inliers", "correspondences", "inlierRatio")
    joined = coarse.join(again, ["case", "ordinal"], "left")
    hit = F.col("_score").isNotNull()
    return joined.withColumns(
        {"score": F.greatest("score", "_score"), "box": F.coalesce("_box", "box"), "method": F.when(hit, "orb").otherwise(F.col("method"))}
    ).drop("_score", "_box")

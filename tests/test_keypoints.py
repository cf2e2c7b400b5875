"""Homographies of matched points, and pictures turned upright."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import keypoints
from millrace.sources import images


def through(matrix, points):
    mapped = np.column_stack([points, np.ones(len(points))]) @ np.asarray(matrix).T
    return mapped[:, :2] / mapped[:, 2:]


MATRIX = [[0.9, 0.12, 40.0], [-0.08, 1.1, 25.0], [0.0002, -0.0001, 1.0]]


def points(seed, n, noise=0.0, wrong=0):
    rng = np.random.default_rng(seed)
    a = rng.uniform(0, 200, (n, 2)) * [1, 1.5]
    b = through(MATRIX, a) + rng.normal(0, noise, (n, 2)) if noise else through(MATRIX, a)
    b[:wrong] = rng.uniform(0, 400, (wrong, 2))
    return a, b


def test_direct_linear_is_exact():
    a, b = points(1, 4)
    assert np.allclose(keypoints.direct_linear(a, b), MATRIX, atol=1e-6)
    line = np.column_stack([np.arange(5.0), np.arange(5.0)])
    assert keypoints.direct_linear(line, line) is None


@pytest.mark.parametrize(("noise", "wrong"), [(0, 0), (0.3, 10), (0.3, 18)])
def test_sample_consensus_recovers_a_homography(noise, wrong):
    a, b = points(2, 40, noise, wrong)
    matrix, inliers = keypoints.sample_consensus(a, b, 7)
    assert inliers[wrong:].all() and inliers[:wrong].sum() <= 2
    corners = np.array([[0, 0], [200, 0], [200, 300], [0, 300.0]])
    assert np.abs(through(matrix, corners) - through(MATRIX, corners)).max() < (1e-4 if not noise else 3)
    again = keypoints.sample_consensus(a, b, 7)
    assert (again[0] == matrix).all()
    assert keypoints.sample_consensus(a[:3], b[:3], 7) is None
    assert keypoints.sample_consensus(np.zeros((9, 2)), np.zeros((9, 2)), 7) is None


def pair_rows(case, ordinal, a, b):
    return [(case, ordinal, *map(float, p), *map(float, q)) for p, q in zip(a, b, strict=True)]


SCHEMA = "case string, ordinal long, from_x double, from_y double, to_x double, to_y double"


def test_best_references_are_looked_at_again(spark):
    a, b = points(3, 40, 0.2, 8)
    few, flat = (a[:11], b[:11]), (a * [1, 0.05], b)
    rng = np.random.default_rng(4)
    rows = pair_rows("c", 0, a, b) + pair_rows("c", 1, *few) + pair_rows("c", 2, *flat) + pair_rows("c", 3, a, rng.uniform(0, 300, a.shape)) + pair_rows("c", 40, a, b)
    pairs = spark.createDataFrame(rows, SCHEMA)
    cases = spark.createDataFrame([("c", 800, 1000, 400, 500)], "case string, width int, height int, w int, h int")
    refs = spark.createDataFrame([(i, 200, 300) for i in range(41)], "ordinal long, r_width int, r_height int")
    coarse = spark.createDataFrame([("c", i, 0.5 if i else 0.95, "phash") for i in range(41)], "case string, ordinal long, score double, method string")
    coarse = coarse.withColumn("box", F.struct(*[F.lit(k).alias(c) for k, c in enumerate(("x", "y", "width", "height"))]))
    asked = []

    def pairs_of(wanted):
        asked.extend(r["ordinal"] for r in wanted.collect())
        return pairs.join(wanted, ["case", "ordinal"], "left_semi")

    got = {r["ordinal"]: r for r in keypoints.with_keypoints(coarse, pairs_of, cases, refs).collect()}
    assert sorted(asked) == list(range(32))  # equal scores in input order
    assert [k for k, r in got.items() if r["method"] == "orb"] == [0] and len(got) == 41
    first = got[0]
    corners = through(MATRIX, np.array([[0, 0], [200, 0], [200, 300], [0, 300.0]]))
    assert abs(first["box"]["x"] - 2 * corners[:, 0].min()) <= 4 and abs(first["box"]["height"] - 2 * np.ptp(corners[:, 1])) <= 6
    assert first["score"] == pytest.approx(max(0.95, min(0.99, 0.83 + 0.08 * min(1, first["inliers"] / 25) + 0.06 * first["inliers"] / 40)))
    assert first["correspondences"] == 40 and first["inlierRatio"] == round(first["inliers"] / 40, 3)
    assert keypoints.verified(pairs.limit(0), cases, refs).collect() == []
    shuffled = keypoints.homographies(pairs.where("ordinal = 0").orderBy(F.rand(3)), ["case", "ordinal"]).first()["matrix"]
    assert shuffled == keypoints.homographies(pairs.where("ordinal = 0"), ["case", "ordinal"]).first()["matrix"]


def tiff(turn, order):
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + struct.pack(order + "HHHIHHI", 2, 0x0100, 3, 1, 9, 0, 0)[:14] + struct.pack(order + "HHIHH", 0x0112, 3, 1, turn, 0) + bytes(4)


def jpeg(turn, order="<"):
    body = b"Exif\0\0" + tiff(turn, order)
    return b"\xff\xd8\xff\xe0\0\x04ab\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda\0\x02"


def png(pixels, turn=None):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w = pixels.shape[:2]
    tag = chunk(b"eXIf", tiff(turn, ">")) if turn else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + tag + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + row.tobytes() for row in pixels))) + chunk(b"IEND", b"")


def test_orientation_tags():
    for turn in range(1, 9):
        assert images.orientation(jpeg(turn)) == images.orientation(jpeg(turn, ">")) == turn
        webp = b"RIFF\0\0\0\0WEBPVP8X\x04\0\0\0abcdEXIF" + struct.pack("<I", len(tiff(turn, "<"))) + tiff(turn, "<")
        assert images.orientation(webp) == turn
    for broken in (b"", b"\xff\xd8", jpeg(9), jpeg(0), jpeg(3)[:30], b"\x89PNG\r\n\x1a\n\0\0", b"GIF89a", b"\xff\xd8\xff\xe1\0\0"):
        assert images.orientation(broken) == 1


def test_eight_files_give_one_picture(spark, tmp_path):
    picture = np.random.default_rng(1).integers(0, 256, (20, 30, 3)).astype(np.uint8)
    stored = {1: picture, 2: picture[:, ::-1], 3: picture[::-1, ::-1], 4: picture[::-1], 5: picture.swapaxes(0, 1), 6: np.rot90(picture), 7: picture[::-1, ::-1].swapaxes(0, 1), 8: np.rot90(picture, -1)}
    for turn, pixels in stored.items():
        (tmp_path / f"{turn}.png").write_bytes(png(np.ascontiguousarray(pixels), turn))
    rows = images.image_pixels(spark, str(tmp_path)).collect()
    assert len(rows) == 8 and {(r["width"], r["height"]) for r in rows} == {(30, 20)}
    for r in rows:
        got = np.frombuffer(r["rgba"], np.uint8).reshape(20, 30, 4)
        assert (got[..., :3] == picture).all(), r["id"]

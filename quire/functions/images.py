"""Numeric analysis of grey page rasters: a numpy core and pandas UDFs around it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

from quire.functions import fixed


def otsu(gray: np.ndarray) -> int:
    """The level that separates the two groups of brightness best (the first of equals); 128 for one level."""
    counts = np.bincount(np.asarray(gray, np.uint8).ravel(), minlength=256).astype(float)
    dark, dark_sum = counts.cumsum(), (counts * np.arange(256)).cumsum()
    light = dark[-1] - dark
    ok = (dark > 0) & (light > 0)
    if not ok.any():
        return 128
    with np.errstate(divide="ignore", invalid="ignore"):
        between = dark * light * (dark_sum / dark - (dark_sum[-1] - dark_sum) / light) ** 2
    return int(np.where(ok, between, -1.0).argmax())


def classify(ink: float, empty: float) -> str:
    if ink < fixed.BLANK_INK:
        return "blank"
    if ink > fixed.HEAVY_INK:
        return "heavy"
    if empty < fixed.MIN_EMPTY_ROWS:
        return "image"
    return "sparse" if empty > fixed.MAX_EMPTY_ROWS else "text"


def analyse(samples: bytes, height: int, width: int, channels: int = 1) -> tuple[float, float, bool, str]:
    """(ink_ratio, empty_row_fraction, looks_like_text, reason). Ink is darker than the threshold, not equal."""
    pixels = np.frombuffer(samples or b"", np.uint8)
    if not pixels.size or pixels.size != height * width * channels:
        return 0.0, 1.0, False, "unreadable pixel buffer"
    pixels = pixels.reshape(height, width, channels)
    gray = pixels[:, :, 0] if channels == 1 else pixels.mean(axis=2).astype(np.uint8)
    ink = gray < otsu(gray)
    share, empty = float(ink.mean()), float((ink.mean(axis=1) < fixed.EMPTY_ROW_INK).mean())
    kind = classify(share, empty)
    return round(share, 5), round(empty, 4), kind == "text", fixed.REASONS[kind]


def rotated(page: np.ndarray, degrees: float) -> np.ndarray:
    """Bilinear rotation about the centre, counter-clockwise, same size, zero outside."""
    h, w = page.shape
    t = np.deg2rad(degrees)
    y, x = np.mgrid[0:h, 0:w].astype(np.float32)
    cy, cx = (h - 1) / 2, (w - 1) / 2
    sx = np.cos(t) * (x - cx) - np.sin(t) * (y - cy) + cx
    sy = np.sin(t) * (x - cx) + np.cos(t) * (y - cy) + cy
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    fx, fy = sx - x0, sy - y0
    padded = np.pad(page, 1)

    def at(yy: np.ndarray, xx: np.ndarray) -> np.ndarray:
        return padded[np.clip(yy + 1, 0, h + 1), np.clip(xx + 1, 0, w + 1)]

    return (at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx) * (1 - fy) + (at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx) * fy


def skew_angle(gray: np.ndarray, most: float = 3.0, step: float = 0.25, most_width: int = 800) -> float:
    """The rotation whose row sums vary most: text lines are level then. The first of equals."""
    if gray.shape[1] > most_width:
        ratio = gray.shape[1] / most_width
        rows = (np.arange(max(1, int(gray.shape[0] / ratio))) * ratio).astype(int)
        gray = gray[rows][:, (np.arange(most_width) * ratio).astype(int)]
    page = 255 - gray.astype(np.float32)
    angles = np.arange(-most, most + 1e-9, step)
    scores = [np.var((page if abs(a) < 1e-9 else rotated(page, a)).sum(axis=1)) for a in angles]
    return float(angles[int(np.argmax(scores))])


def deskewed(gray: np.ndarray) -> np.ndarray:
    angle = skew_angle(gray)
    return gray if abs(angle) < 0.25 else (255 - rotated(255 - gray.astype(np.float32), angle)).round().astype(np.uint8)


#: Built without a session, so that the module can be imported before there is one.
STATS = StructType().add("ink_ratio", DoubleType()).add("empty_row_fraction", DoubleType()).add("looks_like_text", BooleanType()).add("reason", StringType())


@F.pandas_udf(STATS)
def page_stats(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Of (samples, height, width) columns of grey rasters."""
    for samples, height, width in parts:
        rows = [analyse(s, int(h), int(w)) for s, h, w in zip(samples, height, width, strict=True)]
        yield pd.DataFrame(rows, columns=["ink_ratio", "empty_row_fraction", "looks_like_text", "reason"])


@F.pandas_udf(DoubleType())
def page_skew(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for samples, height, width in parts:
        yield pd.Series([skew_angle(np.frombuffer(s, np.uint8).reshape(int(h), int(w))) for s, h, w in zip(samples, height, width, strict=True)])


def page_reason(ink: Column, empty: Column) -> Column:
    """The classification as an expression over the two measures."""
    r = fixed.REASONS
    return F.when(ink < fixed.BLANK_INK, r["blank"]).when(ink > fixed.HEAVY_INK, r["heavy"]).when(empty < fixed.MIN_EMPTY_ROWS, r["image"]).when(empty > fixed.MAX_EMPTY_ROWS, r["sparse"]).otherwise(r["text"])

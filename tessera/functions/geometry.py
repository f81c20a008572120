"""Rectangles (x0, y0, x1, y1 in points, top-down) and page margins as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the margin rules, in points or as shares.
DEFAULT_MARGINS = {"header": 50.0, "footer": 40.0, "left": 0.0, "right": 0.0}
MAX_FRACTION = 0.45
COVERAGE, EDGE_TOUCH, EDGE_REACH = 0.5, 10.0, 24.0
PT_PER_MM = 72.0 / 25.4

BOX = ("x0", "y0", "x1", "y1")


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in BOX)


def area(b: tuple) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def intersection(a: tuple, b: tuple) -> tuple:
    return (F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))


def intersects(a: tuple, b: tuple, pad: float = 0.0) -> Column:
    """Whether a and b, grown by pad, share some area."""
    return (a[0] < b[2] + pad) & (b[0] - pad < a[2]) & (a[1] < b[3] + pad) & (b[1] - pad < a[3])


def contains(outer: tuple, inner: tuple, slack: float = 0.0) -> Column:
    return (inner[0] >= outer[0] - slack) & (inner[1] >= outer[1] - slack) & (inner[2] <= outer[2] + slack) & (inner[3] <= outer[3] + slack)


def inflated(b: tuple, by: float) -> tuple:
    return (b[0] - by, b[1] - by, b[2] + by, b[3] + by)


def union_box(a: tuple, b: tuple) -> tuple:
    return (F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3]))


def to_mm(pt: Column) -> Column:
    return pt / PT_PER_MM


def to_pt(mm: Column) -> Column:
    return mm * PT_PER_MM


def describe_points(pt: Column) -> Column:
    return F.format_string("%.0f pt (%.1f mm)", pt, to_mm(pt))


def normal_margins(raw: dict[str, Column], width: Column, height: Column) -> dict[str, Column]:
    """The four margins: defaults for what is missing or no number, from 0 to 45 % of the page side."""
    out = {}
    for side, default in DEFAULT_MARGINS.items():
        given = F.greatest(F.lit(0.0), raw[side].try_cast("double")) if side in raw else F.lit(None).cast("double")
        cap = (height if side in ("header", "footer") else width) * MAX_FRACTION
        out[side] = F.least(F.coalesce(given, F.lit(default)), F.coalesce(cap, F.lit(1e18)))
    return out


def content_box(width: Column, height: Column, m: dict[str, Column]) -> tuple:
    return (m["left"], m["header"], F.greatest(m["left"], width - m["right"]), F.greatest(m["header"], height - m["footer"]))


def band_boxes(width: Column, height: Column, m: dict[str, Column]) -> Column:
    """The non-empty bands as an array of (side, x0, y0, x1, y1); none overlap."""
    zero = F.lit(0.0)
    top, bottom = F.least(m["header"], height), F.greatest(height - m["footer"], zero)
    band = lambda side, a, b, c, d, on: F.when(on, F.struct(F.lit(side).alias("side"), a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1")))
    return F.filter(
        F.array(
            band("header", zero, zero, width, top, m["header"] > 0),
            band("footer", zero, bottom, width, height, m["footer"] > 0),
            band("left", zero, top, F.least(m["left"], width), bottom, (bottom > top) & (m["left"] > 0)),
            band("right", F.greatest(width - m["right"], zero), top, width, bottom, (bottom > top) & (m["right"] > 0)),
        ),
        lambda x: x.isNotNull(),
    )


def which_margin(b: tuple, width: Column, height: Column, m: dict[str, Column]) -> Column:
    """The side that owns a box, or null: header, footer, left, right, the first that does.

    A band owns what lies in it by half. A side band also owns what comes close to the trim, pokes
    into the band and ends soon after it.
    """
    w, h = F.greatest(b[2] - b[0], F.lit(1e-6)), F.greatest(b[3] - b[1], F.lit(1e-6))
    zero = F.lit(0.0)
    top = F.greatest(zero, F.least(b[3], m["header"]) - b[1]) / h
    bottom = F.greatest(zero, b[3] - (height - m["footer"])) / h
    left, right = F.greatest(zero, F.least(b[2], m["left"]) - b[0]), F.greatest(zero, b[2] - (width - m["right"]))
    return (
        F.when((m["header"] > 0) & (top >= COVERAGE), "header")
        .when((m["footer"] > 0) & (bottom >= COVERAGE), "footer")
        .when((m["left"] > 0) & ((left / w >= COVERAGE) | ((b[0] <= EDGE_TOUCH) & (left > 0) & (b[2] <= m["left"] + EDGE_REACH))), "left")
        .when((m["right"] > 0) & ((right / w >= COVERAGE) | ((b[2] >= width - EDGE_TOUCH) & (right > 0) & (b[0] >= width - m["right"] - EDGE_REACH))), "right")
    )


def padded(b: tuple, pad: float, width: Column, height: Column) -> tuple:
    """b grown by pad and kept on the page."""
    zero = F.lit(0.0)
    return (F.greatest(zero, b[0] - pad), F.greatest(zero, b[1] - pad), F.least(width, b[2] + pad), F.least(height, b[3] + pad))


def slid_inside(b: tuple, width: Column, height: Column) -> tuple:
    """b moved onto the page without changing its size; what is larger than the page starts at 0."""
    dx, dy = b[2] - b[0], b[3] - b[1]
    x0 = F.greatest(F.lit(0.0), F.least(b[0], width - dx))
    y0 = F.greatest(F.lit(0.0), F.least(b[1], height - dy))
    return (x0, y0, F.least(width, x0 + dx), F.least(height, y0 + dy))


def anchored(b: tuple, width: Column, height: Column) -> Column:
    """Distance from the nearer edge per axis (the left and the top on a tie), and the size."""
    right, bottom = (width - b[2]) < b[0], (height - b[3]) < b[1]
    return F.struct(
        F.when(right, "right").otherwise("left").alias("x_edge"), F.when(right, width - b[2]).otherwise(b[0]).alias("dx"),
        F.when(bottom, "bottom").otherwise("top").alias("y_edge"), F.when(bottom, height - b[3]).otherwise(b[1]).alias("dy"), (b[2] - b[0]).alias("w"), (b[3] - b[1]).alias("h"),
    )


def from_anchor(a: Column, width: Column, height: Column) -> tuple:
    """The box of an anchor on a page of another size, kept on the page."""
    x0 = F.when(a["x_edge"] == "right", width - a["dx"] - a["w"]).otherwise(a["dx"])
    y0 = F.when(a["y_edge"] == "bottom", height - a["dy"] - a["h"]).otherwise(a["dy"])
    return slid_inside((x0, y0, x0 + a["w"], y0 + a["h"]), width, height)


def page_numbers(text: Column, total: Column) -> Column:
    """Pages of an expression such as `1, 3, 9-7`, sorted and within the document."""
    chunks = F.transform(F.split(text, "[,;]+"), lambda c: F.trim(c))
    lo, hi = (lambda c: F.regexp_extract(c, r"^(\d+)\s*[-–]\s*(\d+)$", 1).try_cast("int")), (lambda c: F.regexp_extract(c, r"^(\d+)\s*[-–]\s*(\d+)$", 2).try_cast("int"))
    none = F.array().cast("array<int>")
    pages = F.transform(chunks, lambda c: F.when(lo(c).isNotNull(), F.sequence(F.least(lo(c), hi(c)), F.greatest(lo(c), hi(c)))).when(c.rlike(r"^\d+$"), F.array(c.try_cast("int"))).otherwise(none))
    return F.array_sort(F.array_distinct(F.filter(F.flatten(pages), lambda p: (p >= 1) & (p <= total))))

"""Reading order of pages from boxes of text: columns, full-width headers, paragraphs.

A page's boxes are few and are read together, so a page is one call of a grouped function; pages go to as many tasks as there are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame

# What makes two columns.
LEAST_BOXES, ZONE, LEAST_GAP, LEAST_GAP_SHARE, CROSSING = 6, (0.15, 0.85), 10, 0.02, 0.12
SIDE_BOXES, SIDE_HEIGHT, SIDE_WIDTH, MOST_HEADER, LEAD_LINES, PARAGRAPH_LINES = 0.10, 0.25, 0.20, 0.5, 1.5, 0.8
SCHEMA = "document_id string, page int, columns int, text string"


@dataclass(frozen=True)
class Box:
    x0: float
    y0: float
    x1: float
    y1: float
    text: str

    @property
    def mid(self) -> float:
        return (self.x0 + self.x1) / 2

    @property
    def height(self) -> float:
        return self.y1 - self.y0


def _tall(boxes: list[Box]) -> float:
    return max((b.y1 for b in boxes), default=0.0) - min((b.y0 for b in boxes), default=0.0)


def _wide(boxes: list[Box]) -> float:
    return max((b.x1 for b in boxes), default=0.0) - min((b.x0 for b in boxes), default=0.0)


def line_height(boxes: list[Box]) -> float:
    return median([b.height for b in boxes if b.height > 0] or [10.0])


def gutter(boxes: list[Box], width: float) -> tuple[int, int] | None:
    """The widest run of hardly covered points in the middle of the page that has enough text on both sides."""
    if len(boxes) < LEAST_BOXES or width <= 0:
        return None
    size = math.ceil(width) + 2
    edge = [0] * (size + 1)
    for b in boxes:
        a, z = max(0, math.floor(b.x0)), min(size - 1, math.ceil(b.x1))
        if a < z:
            edge[a] += 1
            edge[z] -= 1
    runs, begin, cover = [], None, 0
    low, high, most = int(ZONE[0] * width), int(ZONE[1] * width), max(1, int(CROSSING * len(boxes)))
    for x in range(high + 1):
        cover += edge[x]
        free = low <= x < high and cover <= most
        if free and begin is None:
            begin = x
        elif not free and begin is not None:
            runs.append((begin, x))
            begin = None
    for a, z in sorted(runs, key=lambda r: r[0] - r[1]):
        sides = [[b for b in boxes if (b.mid < (a + z) / 2) == left] for left in (True, False)]
        wide_enough = z - a >= max(LEAST_GAP, LEAST_GAP_SHARE * width)
        if wide_enough and all(len(s) >= SIDE_BOXES * len(boxes) and _tall(s) >= SIDE_HEIGHT * _tall(boxes) and _wide(s) >= SIDE_WIDTH * width for s in sides):
            return a, z
    return None


def paragraphs(boxes: list[Box], typical: float) -> str:
    """Boxes from top to bottom, a blank line where the gap before one is large."""
    out, bottom = [], None
    for b in sorted((b for b in boxes if b.text.strip()), key=lambda b: (b.y0, b.x0)):
        if bottom is not None and b.y0 - bottom > PARAGRAPH_LINES * typical:
            out.append("")
        out.append(b.text.strip("\n").rstrip())
        bottom = b.y1
    return "\n".join(out)


def reading_groups(boxes: list[Box], gap: tuple[int, int]) -> list[list[Box]] | None:
    """Header, what leads the right column, left column, right column; None if full-width boxes fill the page."""
    typical = line_height(boxes)
    across = [b for b in boxes if b.x0 < gap[0] and b.x1 > gap[1]]
    columns = [b for b in boxes if b not in across]
    if not columns:
        return None
    heads = [c for c in across if all((b.y0 + b.y1) / 2 >= c.y0 - 1 for b in columns)]
    bands: list[list[float]] = []
    for h in sorted(heads, key=lambda b: b.y0):
        if bands and h.y0 <= bands[-1][1] + 0.5:
            bands[-1][1] = max(bands[-1][1], h.y1)
        else:
            bands.append([h.y0, h.y1])
    if sum(b - a for a, b in bands) > MOST_HEADER * _tall(boxes) > 0:
        return None
    end = max((b for _, b in bands), default=None)
    header, left, right = [], [], []
    for b in boxes:
        y = (b.y0 + b.y1) / 2
        if any(a - 1 <= y <= z + 1 for a, z in bands) or (end is not None and b.y1 <= end + 1):
            header.append(b)
        elif b in across or b.mid < sum(gap) / 2:
            left.append(b)
        else:
            right.append(b)
    if header:  # a title's tall boxes belong to the header they overlap
        top, low, page = min(b.y0 for b in header), max(b.y1 for b in header), max(b.y1 for b in boxes)
        tall = [b for b in left + right if b.y0 < low and b.y1 > top and b.y0 < 0.25 * page and b.height >= 3 * typical]
        header, left, right = header + tall, [b for b in left if b not in tall], [b for b in right if b not in tall]
    lead: list[Box] = []
    if left and right and min(b.y0 for b in right) < min(b.y0 for b in left) - 1:
        start = min(b.y0 for b in left)
        above, below = [b for b in right if b.y1 <= start + 1], [b for b in right if b.y1 > start + 1]
        if above and (not below or min(b.y0 for b in below) - max(b.y1 for b in above) >= LEAD_LINES * typical):
            lead, right = above, below
    return [header, lead, left, right]


def page_text(boxes: list[Box], width: float) -> tuple[int, str]:
    """(columns, text) of a page."""
    found = gutter(boxes, width)
    groups = reading_groups(boxes, found) if found else None
    typical = line_height(boxes)
    if groups is None:
        return 1, paragraphs(boxes, typical)
    return 2, "\n\n".join(t for t in (paragraphs(g, typical) for g in groups) if t.strip())


def pages(boxes: DataFrame) -> DataFrame:
    """document_id, page, columns, text from boxes: document_id, page, width, x0, y0, x1, y1, text."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [Box(*map(float, r[:4]), r[4] or "") for r in pdf[["x0", "y0", "x1", "y1", "text"]].itertuples(index=False)]
        columns, text = page_text(own, float(pdf["width"].iloc[0]))
        return pd.DataFrame([(pdf["document_id"].iloc[0], int(pdf["page"].iloc[0]), columns, text)], columns=["document_id", "page", "columns", "text"])

    return boxes.select("document_id", "page", "width", "x0", "y0", "x1", "y1", "text").groupBy("document_id", "page").applyInPandas(run, SCHEMA)

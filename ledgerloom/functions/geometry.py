"""Boxes given as struct<x1,y1,x2,y2>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(b: Column) -> Column:
    return F.greatest(F.lit(0), b.x2 - b.x1) * F.greatest(F.lit(0), b.y2 - b.y1)


def intersection(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)) * F.greatest(F.lit(0), F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))


def iou(a: Column, b: Column) -> Column:
    i = intersection(a, b)
    union = area(a) + area(b) - i
    return F.when(union > 0, i / union).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    least = F.least(area(a), area(b))
    return F.when(least > 0, intersection(a, b) / least).otherwise(0.0)


def centre_distance(a: Column, b: Column) -> Column:
    return F.hypot((a.x1 + a.x2 - b.x1 - b.x2) / 2.0, (a.y1 + a.y2 - b.y1 - b.y2) / 2.0)

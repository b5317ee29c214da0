"""Set algebra on sorted arrays of vertex ids, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def intersection(a, b, below=None, without=()) -> Column:
    """a and b, below a bound if given, without given ids; sorted."""
    out = F.array_sort(F.array_intersect(a, b))
    return bounded(out, below, without)


def bounded(a, below=None, without=()) -> Column:
    """The elements of a under the bound, without given ids; the order stays."""
    a = F.col(a) if isinstance(a, str) else a
    if below is None and not without:
        return a

    def ok(x):
        tests = [x < below] if below is not None else []
        tests += [x != w for w in without]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    return F.filter(a, ok)


def difference(a, b, owner, below=None) -> Column:
    """a without b and without b's owner, below a bound if given; sorted. b is a neighbour list, which its owner is never in."""
    b = F.col(b) if isinstance(b, str) else b
    return bounded(F.array_sort(F.array_except(a, F.array_append(b, owner))), below)


def of_label(a, label, below=None, without=()) -> Column:
    """The ids of a, an array of struct(id, vlabel), with a label, under the bound, without given ids; the order stays."""
    a = F.col(a) if isinstance(a, str) else a
    return bounded(F.transform(F.filter(a, lambda x: x["vlabel"] == label), lambda x: x["id"]), below, without)


def labelled_intersection(a, b, label, below=None, without=()) -> Column:
    """The ids with a label that are in a, an array of struct(id, vlabel), and in b, an array of ids; sorted."""
    return intersection(of_label(a, label), b, below, without)


def labelled_difference(a, label, owner, b=None, below=None) -> Column:
    """The ids of a, an array of struct(id, vlabel), with a label and without the owner; without its neighbours b too if they are given (vertex-induced); sorted."""
    if b is None:
        return F.array_sort(of_label(a, label, below, [owner]))
    return difference(of_label(a, label), b, owner, below)


def union(a, b) -> Column:
    """a or b; sorted."""
    return F.array_sort(F.array_union(a, b))


def size(a) -> Column:
    """The number of elements, as long."""
    return F.size(a).cast("long")


def contains(a, x) -> Column:
    """Whether x is in a."""
    return F.array_contains(a, x)

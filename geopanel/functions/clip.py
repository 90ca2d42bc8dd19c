"""Polygon clipping in higher-order functions: rings cut at axis-parallel lines and put together again.

Rings are closed arrays of (x, y) with their inside on the left: outlines
counter-clockwise, holes clockwise. A line cuts the rings that cross it into
chains on the side that is kept. Seen along the line, the chains' ends lie in
pairs, so the n-th chain that leaves the kept side, in the order of the line,
goes on with the n-th that enters it. Following these links gives whole rings: a
concave outline falls into several, and a hole that meets the line becomes part
of the outline.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "array<struct<x:double,y:double>>"


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


class Line:
    """The half-plane on one side of ``axis = bound``; ``above`` keeps the larger coordinates."""

    def __init__(self, axis: str, bound: Column, above: bool):
        self.axis, self.other, self.bound, self.above = axis, "y" if axis == "x" else "x", bound, above

    def keeps(self, p: Column) -> Column:
        return p[self.axis] >= self.bound if self.above else p[self.axis] <= self.bound

    def crossing(self, p: Column, q: Column) -> Column:
        """Where the edge p-q meets the line."""
        part = F.coalesce(F.try_divide(self.bound - p[self.axis], q[self.axis] - p[self.axis]), F.lit(0.0))
        along = p[self.other] + part * (q[self.other] - p[self.other])
        return _point(self.bound, along) if self.axis == "x" else _point(along, self.bound)

    def chains(self, ring: Column) -> Column:
        """The kept chains of a ring that crosses the line, with the places where they begin and end on it."""
        corners = F.slice(ring, F.lit(1), F.size(ring) - 1)
        first = F.array_position(F.transform(corners, lambda p: self.keeps(p)), False).cast("int")
        # from an outside corner on, no chain runs over the ring's end
        turned = F.concat(
            F.slice(corners, first, F.size(corners)), F.slice(corners, F.lit(1), first - 1), F.slice(corners, first, F.lit(1))
        )

        def cut(w: Column) -> Column:
            flags = F.transform(w, lambda p: self.keeps(p))
            steps = F.sequence(F.lit(1), F.size(w) - 1)
            enter = F.filter(steps, lambda i: ~F.get(flags, i - 1) & F.get(flags, i))
            leave = F.filter(steps, lambda i: F.get(flags, i - 1) & ~F.get(flags, i))

            def chain(i: Column, j: Column) -> Column:
                begin = self.crossing(F.get(w, i - 1), F.get(w, i))
                end = self.crossing(F.get(w, j - 1), F.get(w, j))
                return F.struct(
                    F.concat(F.array(begin), F.slice(w, i + 1, j - i), F.array(end)).alias("points"),
                    begin[self.other].alias("begin"),
                    end[self.other].alias("end"),
                )

            return F.zip_with(enter, leave, chain)

        # the turned ring is computed once, as the only element of an array
        return F.flatten(F.transform(F.array(turned), cut))

    def linked(self, chains: Column) -> Column:
        """Closed rings from chains."""

        def order(end: str) -> Column:
            placed = F.transform(chains, lambda c, i: F.struct(c[end].alias("at"), i.alias("i")))
            return F.transform(F.array_sort(placed), lambda s: s["i"])

        def joined(enter: Column, leave: Column) -> Column:
            n = F.size(chains)
            follows = F.transform(
                F.sequence(F.lit(0), n - 1), lambda c: F.get(enter, (F.array_position(leave, c) - 1).cast("int"))
            )
            zero = F.struct(
                F.array().cast(f"array<{POINTS}>").alias("rings"),
                F.array().cast(POINTS).alias("now"),
                F.lit(0).alias("at"),
                F.lit(0).alias("first"),
                F.array().cast("array<int>").alias("seen"),
            )

            def step(s: Column, _: Column) -> Column:
                now = F.concat(s["now"], F.get(chains, s["at"])["points"])
                seen = F.concat(s["seen"], F.array(s["at"]))
                onward = F.get(follows, s["at"])
                closed = onward == s["first"]
                fresh = F.coalesce(
                    F.get(F.filter(F.sequence(F.lit(0), n - 1), lambda c: ~F.array_contains(seen, c)), F.lit(0)), F.lit(0)
                )
                ring = F.concat(now, F.slice(now, 1, 1))
                return F.struct(
                    F.when(closed, F.concat(s["rings"], F.array(ring))).otherwise(s["rings"]).alias("rings"),
                    F.when(closed, F.array().cast(POINTS)).otherwise(now).alias("now"),
                    F.when(closed, fresh).otherwise(onward).alias("at"),
                    F.when(closed, fresh).otherwise(s["first"]).alias("first"),
                    seen.alias("seen"),
                )

            return F.aggregate(F.sequence(F.lit(1), n), zero, step, lambda s: s["rings"])

        orders = F.array(F.struct(order("begin").alias("enter"), order("end").alias("leave")))
        found = F.flatten(F.transform(orders, lambda o: joined(o["enter"], o["leave"])))
        return F.when(F.size(chains) > 0, found).otherwise(F.array().cast(f"array<{POINTS}>"))

    def clip(self, rings: Column) -> Column:
        """The rings of what lies on the kept side."""

        def crosses(r: Column) -> Column:
            return F.exists(r, lambda p: self.keeps(p)) & F.exists(r, lambda p: ~self.keeps(p))

        whole = F.filter(rings, lambda r: F.forall(r, lambda p: self.keeps(p)))
        cut = F.flatten(F.transform(F.filter(rings, crosses), lambda r: self.chains(r)))
        linked = F.flatten(F.transform(F.array(cut), lambda c: self.linked(c)))
        return F.concat(whole, linked)


def twice_area(ring: Column) -> Column:
    """Twice the shoelace area of a closed ring, positive when counter-clockwise."""
    ends = F.slice(ring, F.lit(2), F.size(ring) - 1)
    terms = F.zip_with(
        F.slice(ring, F.lit(1), F.size(ring) - 1), ends, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]
    )
    return F.aggregate(terms, F.lit(0.0), lambda acc, v: acc + v)


def _inside(ring: Column, p: Column) -> Column:
    """Even-odd test of a point against a closed ring."""
    n = F.size(ring) - 1
    hits = F.zip_with(
        F.slice(ring, F.lit(1), n),
        F.slice(ring, F.lit(2), n),
        lambda a, b: ((a["y"] > p["y"]) != (b["y"] > p["y"]))
        & (p["x"] < a["x"] + F.try_divide((b["x"] - a["x"]) * (p["y"] - a["y"]), b["y"] - a["y"])),
    )
    return F.size(F.filter(hits, lambda h: h)) % 2 == 1


def rings_wkt(rings: Column) -> Column:
    """POLYGON or MULTIPOLYGON text of rings; each hole goes with the outline that holds it."""

    def text(ring: Column) -> Column:
        shown = F.transform(ring, lambda p: F.concat(p["x"].cast("string"), F.lit(" "), p["y"].cast("string")))
        return F.concat(F.lit("("), F.array_join(shown, ", "), F.lit(")"))

    outlines = F.filter(rings, lambda r: twice_area(r) > 0)
    holes = F.filter(rings, lambda r: twice_area(r) < 0)

    def polygon(outline: Column) -> Column:
        own = F.filter(holes, lambda h: _inside(outline, F.get(h, F.lit(0))))
        parts = F.concat(F.array(text(outline)), F.transform(own, text))
        return F.concat(F.lit("("), F.array_join(parts, ", "), F.lit(")"))

    polygons = F.transform(outlines, polygon)
    joined = F.array_join(polygons, ", ")
    return F.when(F.size(outlines) == 1, F.concat(F.lit("POLYGON "), joined)).otherwise(
        F.concat(F.lit("MULTIPOLYGON ("), joined, F.lit(")"))
    )

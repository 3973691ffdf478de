"""Embedded functions as column expressions: exponential, stitching, sampled, and stack programs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, lo: Column | float, hi: Column | float) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def exponential(x: Column, c0: float, c1: float, n: float, bounds: tuple[float, float] | None = None) -> Column:
    """c0 + x^n (c1 - c0), clamped to the range alone."""
    y = F.lit(c0) + F.pow(x, F.lit(float(n))) * (c1 - c0)
    return clamp(y, *bounds) if bounds else y


def stitching(x: Column, domain: tuple[float, float], bounds: list[float], encode: list[tuple[float, float]], parts: list) -> Column:
    """Clamps x to the domain, finds its interval, maps that to the part's own interval and applies the part."""
    t = clamp(x, *domain)
    edges = [domain[0], *bounds, domain[1]]
    out = None
    for k in range(len(parts) - 1, -1, -1):
        lo, hi = edges[k], edges[k + 1]
        e0, e1 = encode[k]
        inner = parts[k](F.lit(e0) if hi == lo else F.lit(e0) + (t - lo) * ((e1 - e0) / (hi - lo)))
        out = inner if out is None else F.when(t < bounds[k], inner).otherwise(out)
    return out


def sampled_1d(x: Column, samples: list[int], e0: float, e1: float, decode: tuple[float, float] = (0.0, 1.0)) -> Column:
    """Linear interpolation in a table of bytes at clamp(x) * e1 + e0; samples outside the table count as 0."""
    table = F.array(*[F.lit(float(s)) for s in samples])
    pos = clamp(x, 0.0, 1.0) * e1 + e0
    low = F.floor(pos).cast("int")
    at = lambda i: F.coalesce(F.get(table, i), F.lit(0.0))
    y = at(low) * (F.lit(1.0) - (pos - low)) + at(low + 1) * (pos - low)
    return y / 255 * (decode[1] - decode[0]) + decode[0]


def sampled_2d(x: Column, y: Column, samples: list[list[int]]) -> Column:
    """Bilinear interpolation in rows of bytes over the unit square."""
    rows, width = len(samples), len(samples[0])
    table = F.array(*[F.lit(float(s)) for row in samples for s in row])
    px, py = clamp(x, 0.0, 1.0) * (width - 1), clamp(y, 0.0, 1.0) * (rows - 1)
    ix, iy = F.floor(px).cast("int"), F.floor(py).cast("int")

    def at(i: Column, j: Column) -> Column:
        return F.when((i < width) & (j < rows), F.coalesce(F.get(table, j * width + i), F.lit(0.0))).otherwise(0.0)

    fx, fy = px - ix, py - iy
    return ((at(ix, iy) * (1 - fx) + at(ix + 1, iy) * fx) * (1 - fy) + (at(ix, iy + 1) * (1 - fx) + at(ix + 1, iy + 1) * fx) * fy) / 255


class StackError(ValueError):
    pass


def program(source: str, inputs: list[Column], outputs: int) -> list[Column]:
    """A stack program compiled to expressions, by running it on columns.

    Operators: numbers, add, sub, mul, abs, dup, exch, roll, index, cvr, pop. The operands of roll and index must be
    constants. The stack must end with `outputs` values.
    """
    body = source[source.index("{") + 1 : source.rindex("}")]
    stack: list[Column | float] = list(inputs)

    def take() -> Column | float:
        if not stack:
            raise StackError("StackUnderflow")
        return stack.pop()

    def whole() -> int:
        n = take()
        if isinstance(n, Column) or n != int(n):
            raise StackError("a constant is needed")
        return int(n)

    for word in body.split():
        if word in ("add", "sub", "mul"):
            b, a = take(), take()
            a, b = (x if isinstance(x, Column) else F.lit(float(x)) for x in (a, b))
            stack.append({"add": a + b, "sub": a - b, "mul": a * b}[word])
        elif word == "abs":
            a = take()
            stack.append(F.abs(a) if isinstance(a, Column) else abs(a))
        elif word == "dup":
            a = take()
            stack += [a, a]
        elif word == "exch":
            b, a = take(), take()
            stack += [b, a]
        elif word == "pop":
            take()
        elif word == "cvr":
            a = take()
            stack.append(a.cast("double") if isinstance(a, Column) else float(a))
        elif word == "index":
            n = whole()
            if not 0 <= n < len(stack):
                raise StackError("StackUnderflow")
            stack.append(stack[-1 - n])
        elif word == "roll":
            j, n = whole(), whole()
            if not 0 <= n <= len(stack):
                raise StackError("StackUnderflow")
            if n:
                top = stack[-n:]
                j %= n
                stack[-n:] = top[n - j :] + top[: n - j]
        else:
            try:
                stack.append(float(word))
            except ValueError:
                raise StackError(f"unknown operator {word}") from None
    if len(stack) != outputs:
        raise StackError(f"{len(stack)} values for {outputs} outputs")
    return [x if isinstance(x, Column) else F.lit(float(x)) for x in stack]


def colour(c: Column) -> Column:
    """Kind of a colour array by its size."""
    return F.when(F.size(c) == 1, "Gray").when(F.size(c) == 3, "Rgb").when(F.size(c) == 4, "Cmyk").otherwise("Other")


def matrix_apply(m: list[Column | float], x: Column, y: Column) -> Column:
    a, b, c, d, e, f = (v if isinstance(v, Column) else F.lit(float(v)) for v in m)
    return F.struct((a * x + c * y + e).alias("x"), (b * x + d * y + f).alias("y"))


def rectangle(a: Column) -> Column:
    """left, bottom, right, top of an array of four numbers, in order."""
    return F.when(F.size(a) == 4, F.struct(F.least(a[0], a[2]).alias("left"), F.least(a[1], a[3]).alias("bottom"), F.greatest(a[0], a[2]).alias("right"), F.greatest(a[1], a[3]).alias("top")))


def quads(points: Column) -> Column:
    """The rectangles around each eight numbers of a list of quadrilaterals; numbers left over are dropped."""
    each = F.transform(F.sequence(F.lit(0), F.floor(F.size(points) / 8).cast("int") - 1), lambda i: F.slice(points, i * 8 + 1, 8))
    side = lambda q, k: F.filter(q, lambda _, i: i % 2 == k)
    boxes = F.transform(each, lambda q: F.struct(F.array_min(side(q, 0)).alias("left"), F.array_min(side(q, 1)).alias("bottom"), F.array_max(side(q, 0)).alias("right"), F.array_max(side(q, 1)).alias("top")))
    return F.when(F.size(points) >= 8, boxes)


def flags(value: Column, bits: dict[str, int]) -> list[Column]:
    """A boolean column for each named bit, counted from 1."""
    return [(F.getbit(value.cast("long"), F.lit(b - 1)) == 1).alias(k.lower()) for k, b in bits.items()]

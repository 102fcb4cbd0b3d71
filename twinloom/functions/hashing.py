"""Random draws as pure functions of a key.

A draw that depends only on (stream, key) survives task retries, does not
depend on the partitioning, and is never drawn twice with different results.
"""

from __future__ import annotations

import math
import secrets
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

# 13 hex digits = 52 bits: (integer + 0.5) / 2**52 is exact in a double.
_DIGITS = 13
_SPAN = float(2**52)


TRIES = 64  # of the rejection sampler


@dataclass(frozen=True)
class Draws:
    """A stream of keyed random draws.

    ``Draws(seed)`` is public and repeatable (md5): for tests and for sampling
    decisions that need no secrecy. ``Draws.with_secret()`` keys a SHA-256 stream
    with operating-system entropy: use it for noise on released counts. The key
    appears in query plans, so event logs need the same care as the data.

    ``fast`` streams use xxhash64, several times cheaper and without an
    equivalent in other SQL engines: for drawing rows from released counts,
    which costs no privacy.
    """

    seed: int = 42
    secret: str | None = None
    fast: bool = False
    table: str | None = None

    @staticmethod
    def with_secret(seed: int = 42) -> "Draws":
        return Draws(seed, secrets.token_hex(32))

    def for_table(self, table: str) -> "Draws":
        """The table's own stream: its name is part of every key, so no two tables share draws."""
        return replace(self, table=table)

    def for_sampling(self) -> "Draws":
        return Draws(self.seed, fast=True, table=self.table)

    @property
    def stream(self) -> str:
        """What every key begins with; the length keeps names apart from what follows."""
        return str(self.seed) if self.table is None else f"{self.seed}|{len(self.table)}:{self.table}"

    def digest(self, *key: Column) -> Column:
        parts = [F.coalesce(k.cast("string"), F.lit("")) for k in key]
        text = F.concat_ws("|", F.lit(self.stream), *parts)
        if self.secret is None:
            return F.md5(text)
        return F.sha2(F.concat(F.lit(self.secret), text), 256)

    def key(self, *key: Column) -> Column:
        """A whole number of 52 bits as a double, other than 0: names a row for draws within tasks."""
        return F.conv(F.substring(self.digest(*key), 1, _DIGITS), 16, 10).cast("bigint").cast("double") + F.lit(1.0)

    def uniform(self, *key: Column, draw: int = 0) -> Column:
        """Uniform in (0, 1). ``draw`` 0 and 1 are independent draws of one key."""
        if self.fast:
            bits = F.xxhash64(F.lit(self.stream), F.lit(draw), *key)
            top = F.shiftrightunsigned(bits, 12).cast("double")
            return (top + F.lit(0.5)) / F.lit(_SPAN)
        hexes = F.substring(self.digest(*key), 1 + draw * _DIGITS, _DIGITS)
        whole = F.conv(hexes, 16, 10).cast("bigint").cast("double")
        return (whole + F.lit(0.5)) / F.lit(_SPAN)

    def geometric(self, scale: Column | float, *key: Column) -> Column:
        """Two-sided geometric noise: whole numbers with Laplace-like tails of ``scale``.

        Unlike Laplace noise from doubles it has no gaps that tell counts apart.
        """
        width = scale if isinstance(scale, Column) else F.lit(float(scale))
        up, down = (
            F.floor(-width * F.log(self.uniform(*key, draw=d))).cast("bigint") for d in (0, 1)
        )
        return up - down

    def discrete_gaussian(self, variance: float, *key: Column, tries: int = TRIES) -> Column:
        """Whole numbers with probability proportional to exp(-x^2 / (2 variance)), from draws of 52 bits.

        By rejection from two-sided geometric numbers. Try number t has a key of its own, and the
        first accepted one counts, so the same key gives the same number again. A try is
        accepted with a chance above 0.4; that none of ``tries`` is (and 0 comes out) has a chance below 1e-14.
        """
        width = math.floor(math.sqrt(variance)) + 1

        def attempt(t: Column) -> Column:
            number = self.geometric(float(width), *key, F.lit("try"), t)
            gap = F.abs(number) - F.lit(variance / width)
            chance = F.exp(-(gap * gap) / F.lit(2.0 * variance))
            return F.struct(number.alias("x"), (self.uniform(*key, F.lit("accept"), t) < chance).alias("ok"))

        every = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), attempt)
        return F.coalesce(F.get(F.filter(every, lambda a: a["ok"]), F.lit(0))["x"], F.lit(0).cast("bigint"))

    def gaussian(self, scale: Column | float, *key: Column) -> Column:
        width = scale if isinstance(scale, Column) else F.lit(float(scale))
        radius = F.sqrt(F.lit(-2.0) * F.log(self.uniform(*key)))
        angle = F.lit(2.0 * math.pi) * self.uniform(*key, draw=1)
        return width * radius * F.cos(angle)

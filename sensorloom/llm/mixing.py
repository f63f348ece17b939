"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells by the classes of several margins (source, language, topic). The token weights of the cells are raked: scaled margin
by margin, again and again, until every margin has its target shares. A document is then sampled with a probability proportional to its cell's
raked over observed weight; the largest ratio gets probability 1, so no probability is cut and every target holds in expectation.

That rule lets the rarest cell set the rate of all: one document of a class with a target above its tokens leaves next to nothing of the rest. A
`Mix` states a token budget besides its margins, and the sample then has that share of all tokens. A class or cell that cannot fill its part is taken
whole, and what it lacks goes to the other classes of the margin, or cells of the class, in proportion.

Scale: one aggregation with map-side sums gives the cells. Their number is bounded by the specification: each margin lists its classes, and all
other values form one more. Only these cells come to the driver and go back. Draws are digests of the id and a seed, so they are the same on
every run and partitioning.

Cases: nulls and values that are not listed are class "(other)". A class without tokens cannot be filled; the others then share its target in
proportion, and a margin without any such class is left out. A class with target 0 is never sampled. A document without tokens weighs nothing and gets its cell's probability, or 1 if its whole cell has no tokens. Rows with equal ids
share their draw. Empty tables give no rows. Columns that the margins do not name are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import BLANK_CLASS, BLANKS

OTHER = "(other)"


@dataclass(frozen=True)
class Margin:
    """Target shares of the classes of a value; `rest` is the share of all values that are not listed."""

    name: str
    shares: tuple[tuple[str, float], ...]
    rest: float = 0.0

    def target(self) -> dict[str, float]:
        return dict(self.shares) | {OTHER: self.rest}


class Mix(tuple):
    """Margins with the share of all tokens that a sample of them shall have."""

    def __new__(cls, margins: tuple[Margin, ...], budget: float):
        if not 0 < budget <= 1:
            raise ValueError("the budget is a share of all tokens")
        mix = super().__new__(cls, margins)
        mix.budget = budget
        return mix


def word_count(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, f"{BLANK_CLASS}+"))).cast("long")


def lead_topic(text: Column, topics: int) -> Column:
    """A stand-in where the table has no topic: the text's first run of five or more of the letters a-z, dealt into `topics` classes."""
    word = F.regexp_extract(F.coalesce(text, F.lit("")), "[a-z]{5,}", 0)
    return F.pmod(F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long"), F.lit(topics)).cast("string")


def rake(totals: dict[tuple[str, ...], float], margins: tuple[Margin, ...], rounds: int) -> dict[tuple[str, ...], float]:
    """Raked share of every cell with tokens."""
    whole = math.fsum(totals.values())
    share = {cell: n / whole for cell, n in totals.items() if n > 0}
    for _ in range(rounds):
        for place, margin in enumerate(margins):
            now: dict[str, list[float]] = {}
            for cell in sorted(share):
                now.setdefault(cell[place], []).append(share[cell])
            sums = {name: math.fsum(parts) for name, parts in now.items()}
            target = {name: t for name, t in margin.target().items() if name in sums}
            scale = math.fsum(t for name, t in target.items() if sums[name] > 0)
            if scale > 0:
                factor = {name: target[name] / scale / v if v > 0 else 0.0 for name, v in sums.items()}
                share = {cell: v * factor[cell[place]] for cell, v in share.items()}
    return share


def _filled(wish: dict, room: dict, goal: float) -> dict:
    """min(room, factor * wish) for each key, with the factor that makes the sum the goal, or all room of wishes if that is less."""
    out, left = {k: 0.0 for k in wish}, goal
    open_keys = sorted((k for k in wish if wish[k] > 0), key=lambda k: (room[k] / wish[k], k))
    weight = math.fsum(wish[k] for k in open_keys)
    for at, k in enumerate(open_keys):
        if room[k] * weight > left * wish[k]:
            return out | {k: wish[k] * left / weight for k in open_keys[at:]}
        out[k], left = room[k], max(0.0, left - room[k])
        weight = math.fsum(wish[k] for k in open_keys[at + 1 :])
    return out


def budgeted(
    totals: dict[tuple[str, ...], float], margins: tuple[Margin, ...], rounds: int, budget: float
) -> dict[tuple[str, ...], float]:
    """Tokens to take of every cell with tokens, at most all of them: raking whose steps return what a class or cell lacks to the others."""
    room = {cell: n for cell, n in totals.items() if n > 0}
    goal = budget * math.fsum(room.values())
    taken = {cell: n * budget for cell, n in room.items()}
    for _ in range(rounds):
        for place, margin in enumerate(margins):
            own: dict[str, list[tuple[str, ...]]] = {}
            for cell in sorted(taken):
                if taken[cell] > 0:
                    own.setdefault(cell[place], []).append(cell)
            target = {name: margin.target()[name] for name in own}
            if not any(target.values()):
                continue
            parts = _filled(target, {name: math.fsum(room[c] for c in cells) for name, cells in own.items()}, goal)
            for name, cells in own.items():
                taken.update(_filled({c: taken[c] for c in cells}, room, parts[name]))
    return taken


def mixed(
    docs: DataFrame,
    margins: tuple[Margin, ...],
    *,
    rounds: int = 12,
    seed: str = "mix",
    tokens_col: str = "tokens",
    id_col: str = "doc_id",
) -> DataFrame:
    """Each row's id, classes, tokens, weight (raked over observed), probability and sampled. docs has a column for each margin.

    Plain margins give the largest weight probability 1; a Mix meets its token budget.
    """
    spark = docs.sparkSession
    names = [m.name for m in margins]
    classes = [F.when(F.col(m.name).isin([s for s, _ in m.shares]), F.col(m.name)).otherwise(OTHER).alias(m.name) for m in margins]
    rows = docs.select(F.col(id_col), *classes, F.col(tokens_col).alias("tokens"))
    found = rows.groupBy(*names).agg(F.sum("tokens").alias("tokens")).collect()
    totals = {tuple(r[n] for n in names): float(r["tokens"] or 0) for r in found}
    whole = math.fsum(totals.values())
    share = rake(totals, margins, rounds) if whole > 0 else {}
    weight = {cell: v / (totals[cell] / whole) for cell, v in share.items()}
    most = max(weight.values(), default=0.0) or 1.0
    chance = {cell: w / most for cell, w in weight.items()}
    if isinstance(margins, Mix):
        chance = {cell: n / totals[cell] for cell, n in budgeted(totals, margins, rounds, margins.budget).items()}
    table = [(*cell, weight.get(cell), chance.get(cell, 1.0)) for cell in totals]
    kinds = ", ".join(f"{n} string" for n in names)
    cells = spark.createDataFrame(table, f"{kinds}, weight double, probability double")
    # its size is bounded by the margins' lists
    drawn = rows.join(F.broadcast(cells), names, "left")
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string"))), 1, 12), 16, 10).cast("double")
    return drawn.select(
        id_col, *names, "tokens", "weight", "probability", (draw / float(1 << 48) < F.col("probability")).alias("sampled")
    )

"""Noise, corruption, perturbation and drift. Every draw is a hash of the row id (see functions/hashing.py)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.functions.hashing import M31, gaussian, hash31, signed, unit
from gridlens.functions.scalar import clip, col, ratio
from gridlens.operators import ordered
from gridlens.operators.clean import replace_columns
from gridlens.operators.profile import long_form
from gridlens.operators.quantiles import column_quantiles
from gridlens.operators.sampling import donors, group_counts, smallest_by_hash


def noise_gaussian(df: DataFrame, row_id: str, columns: list[str], level: float = 0.05, seed: int = 42) -> DataFrame:
    """Add ``level`` x standard normal noise; each column has its own seed."""
    return replace_columns(df, {c: F.col(c) + F.lit(level) * gaussian(row_id, seed + j) for j, c in enumerate(columns)})


def noise_sign(df: DataFrame, row_id: str, columns: list[str], epsilon: float = 0.1, seed: int = 42,
               low: float | None = None, high: float | None = None) -> DataFrame:
    """Move each value by +epsilon or -epsilon, clipped to [low, high] if given."""
    def moved(j, c):
        value = F.col(c) + F.lit(epsilon) * signed(row_id, seed + j)
        return value if low is None else clip(value, low, high)

    return replace_columns(df, {c: moved(j, c) for j, c in enumerate(columns)})


def augment(df: DataFrame, row_id: str, columns: list[str], copies: int = 3, seed: int = 42) -> DataFrame:
    """Noisy copies, numbered 1 to ``copies``; copy c moves every value by its own epsilon in [0.01, 0.1]."""
    repeated = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    epsilon = F.lit(0.01) + F.lit(0.09) * unit("copy", seed)
    key = F.col(row_id) * copies + F.col("copy")
    return replace_columns(repeated, {c: F.col(c) + epsilon * signed(key, seed + 1 + j) for j, c in enumerate(columns)})


def corrupt_rows(df: DataFrame, row_id: str, columns: list[str], rate: float = 0.1, seed: int = 42) -> DataFrame:
    """In exactly ``floor(rate x n)`` rows, replace each value by another corrupted row's value of the column.

    Only the chosen rows are permuted, each column in its own order; the others are not moved.
    """
    n = df.count()
    chosen = smallest_by_hash(df, row_id, seed, {None: int(n * rate + 1e-9)})
    marked = df.withColumn("corrupted", chosen)
    picked = marked.where("corrupted").select(row_id, *columns)
    out = picked.select(row_id)
    for j, c in enumerate(columns):
        out = out.join(donors(picked, row_id, c, seed + 1 + j, c), row_id)
    rest = [c for c in df.columns if c not in columns and c != row_id]
    changed = marked.where("corrupted").select(row_id, *rest).join(out, row_id).withColumn("corrupted", F.lit(True))
    return marked.where("not corrupted").unionByName(changed.select(*marked.columns))


def jitter_time(df: DataFrame, row_id: str, ts: str, seconds: int = 10, seed: int = 42) -> DataFrame:
    """Shift each time by a whole number of seconds in [-seconds, seconds)."""
    shift = F.pmod(hash31(row_id, seed), F.lit(2 * seconds)) - seconds
    moved = F.timestamp_micros(F.unix_micros(F.col(ts).cast("timestamp")) + shift * 1000000)
    return replace_columns(df, {ts: moved.cast(df.schema[ts].dataType)})


def flip_labels(df: DataFrame, row_id: str, label: str, rate: float, seed: int = 42) -> DataFrame:
    """Give exactly ``floor(rate x n)`` rows one of the other labels."""
    counts = group_counts(df, label)
    chosen = smallest_by_hash(df, row_id, seed, {None: int(sum(counts.values()) * rate + 1e-9)}, counts={None: sum(counts.values())})
    labels = F.array(*[F.lit(v) for v in sorted(c for c in counts if c is not None)])
    others = F.filter(labels, lambda v: v != F.col(label))
    pick = F.pmod(hash31(row_id, seed + 1), F.greatest(F.size(others), F.lit(1))) + 1
    flipped = F.when(chosen & (F.size(others) > 0), F.try_element_at(others, pick.cast("int"))).otherwise(F.col(label))
    return df.select("*", flipped.alias("flipped_label"), chosen.alias("is_flipped"))


def tag_replay(df: DataFrame, row_id: str, fraction: float = 0.01, seed: int = 42) -> DataFrame:
    return df.withColumn("attack_type", F.when(unit(row_id, seed) < fraction, "Replay").otherwise("Normal"))


def _element_key(row_id: Column | str, index: Column, round_: Column | int = 0) -> Column:
    """One key per (row, element, round)."""
    return (F.pmod(col(row_id), F.lit(M31)) * 1000 + (round_ if isinstance(round_, Column) else F.lit(round_))) * 4096 + index


def perturb_step(features: Column | str, row_id: str, importance: list[float], epsilon: float, seed: int = 42,
                 low: float = 0.0, high: float = 1.0) -> Column:
    """Single step: element j moves by +-10 x epsilon x importance_j, clipped to [low, high]."""
    weights = F.array(*[F.lit(float(w)) for w in importance])
    return F.transform(
        col(features).cast("array<double>"),
        lambda x, j: F.greatest(F.lit(low), F.least(F.lit(high), x + signed(_element_key(row_id, j), seed) * epsilon * 10.0 * weights[j])),
    )


def perturb_projected(features: Column | str, row_id: str, importance: list[float], epsilon: float, alpha: float = 0.01,
                      rounds: int = 10, seed: int = 42, low: float = 0.0, high: float = 1.0) -> Column:
    """Repeated steps on elements of importance above 0.01, each projected to the L2 ball of radius epsilon and clipped."""
    weights = F.array(*[F.lit(float(w) if w > 0.01 else 0.0) for w in importance])
    start = col(features).cast("array<double>")

    def one_round(current, r):
        step = F.zip_with(current, start, lambda a, b: a - b)
        delta = F.transform(step, lambda d, j: d + signed(_element_key(row_id, j, r), seed) * alpha * 10.0 * weights[j])
        # The norm is computed once per round as a second accumulator value.
        sized = F.struct(delta.alias("d"), F.sqrt(F.aggregate(delta, F.lit(0.0), lambda s, d: s + d * d)).alias("n"))
        project = lambda z: F.zip_with(
            start, z["d"], lambda b, d: F.greatest(F.lit(low), F.least(F.lit(high), b + d * F.least(F.lit(1.0), epsilon / F.greatest(z["n"], F.lit(1e-300)))))
        )
        return F.element_at(F.transform(F.array(sized), project), 1)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, one_round)


def random_search(df: DataFrame, row_id: str, features: str, importance: list[float], predict, tries: int = 20,
                  step: float = 0.05, seed: int = 42) -> DataFrame:
    """The closest of ``tries`` random candidates per row whose predicted class differs from the row's own.

    ``predict(df)`` adds ``prediction`` from the column ``features``. Rows without such a candidate are kept with nulls.
    """
    weights = F.array(*[F.lit(float(w) if w > 0.01 else 0.0) for w in importance])
    base = predict(df.select(row_id, F.col(features).cast("array<double>").alias("features"))).select(
        row_id, F.col("features").alias("original"), F.col("prediction").alias("before"))
    candidates = base.withColumn("try", F.explode(F.sequence(F.lit(1), F.lit(tries))))
    size = F.lit(step) * F.pow(F.lit(0.98), F.col("try") - 1) * 20.0
    moved = F.transform("original", lambda x, j: F.greatest(F.lit(0.0), F.least(
        F.lit(1.0), x + (unit(_element_key(row_id, j, F.col("try")), seed) - 0.5) * size * weights[j])))
    scored = predict(candidates.withColumn("features", moved))
    distance = F.sqrt(F.aggregate(F.zip_with("features", "original", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d))
    return scored.groupBy(row_id).agg(
        F.min(F.when(F.col("prediction") != F.col("before"), distance)).alias("distance"),
        F.min_by("features", F.when(F.col("prediction") != F.col("before"), distance)).alias("candidate"),
        F.max(F.col("prediction") != F.col("before")).alias("changed"),
    )


def smoothed_prediction(df: DataFrame, row_id: str, features: str, predict, copies: int = 10, sigma: float = 0.01,
                        seed: int = 42) -> DataFrame:
    """Rounded mean prediction over noisy copies of each row, clipped to [0, 1]."""
    repeated = df.select(row_id, F.col(features).cast("array<double>").alias("features"),
                         F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"))
    noisy = F.transform("features", lambda x, j: F.greatest(F.lit(0.0), F.least(
        F.lit(1.0), x + F.lit(sigma) * gaussian(_element_key(row_id, j, F.col("copy")), seed))))
    scored = predict(repeated.withColumn("features", noisy))
    return scored.groupBy(row_id).agg(F.round(F.avg("prediction")).cast("int").alias("smoothed"))


def squeeze(features: Column | str, digits: int = 2) -> Column:
    """Feature squeezing: round each element."""
    return F.transform(col(features).cast("array<double>"), lambda x: F.round(x, digits))


def diff_summary(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Mean, maximum and L2 norm of (after - before) per named pair of columns."""
    d = {n: F.col(after) - F.col(before) for n, (before, after) in pairs.items()}
    return long_form(df, {
        n: {"mean_diff": F.avg(x), "max_diff": F.max(x), "l2_norm": F.sqrt(F.sum(x * x))} for n, x in d.items()
    })


def feature_shift(df: DataFrame, columns: list[str], row_id: str, is_attack: Column, perturbed: dict[str, Column]) -> DataFrame:
    """Mean absolute move per feature: benign to perturbed, and benign to the attack row of the same rank.

    Ranks pair the two classes up to the smaller one's size; the join is on a unique number.
    """
    benign, attack = df.where(~is_attack), df.where(is_attack)
    own = long_form(benign, {c: {"perturbed_shift": F.avg(F.abs(perturbed[c] - F.col(c)))} for c in columns})
    left = ordered.scan(benign.select(row_id, *columns), [], [row_id], [ordered.row_number("rank")])
    right = ordered.scan(attack.select(row_id, *columns), [], [row_id], [ordered.row_number("rank")])
    right = right.select("rank", *[F.col(c).alias(f"attack_{c}") for c in columns])
    other = long_form(left.join(right, "rank"), {c: {"attack_shift": F.avg(F.abs(F.col(f"attack_{c}") - F.col(c)))} for c in columns})
    return own.join(other, "column_name")


def stability_index(df: DataFrame, columns: list[str], is_recent: Column, bins: int = 10) -> DataFrame:
    """Population stability index of the recent rows against the earlier ones, on bins at the earlier rows' quantiles."""
    parts = df.select(*columns, is_recent.alias("__recent"))
    edges = {c: sorted(set(q)) for c, q in column_quantiles(parts.where("not __recent"), columns, [i / bins for i in range(1, bins)]).items()}
    place = lambda c: sum(((F.col(c) > F.lit(e)).cast("int") for e in edges[c]), F.lit(0))
    binned = parts.select("__recent", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.when(F.col(c).isNotNull(), place(c)).alias("bin")) for c in columns
    ]))).where("bin is not null")
    counts = binned.groupBy("column_name", "bin").agg(
        F.count(F.when(~F.col("__recent"), 1)).alias("e"), F.count(F.when(F.col("__recent"), 1)).alias("r"))
    totals = counts.groupBy("column_name").agg(F.sum("e").alias("te"), F.sum("r").alias("tr"))
    # An empty bin counts as a share of 1e-4 so that the logarithm is finite.
    share = lambda n, total: F.greatest(ratio(n, total), F.lit(1e-4))
    e, r = share("e", "te"), share("r", "tr")
    return counts.join(totals, "column_name").groupBy("column_name").agg(F.sum((r - e) * F.log(r / e)).alias("psi"))

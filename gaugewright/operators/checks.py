"""Data-quality checks of generated suites: one error row (scope, key, error) per violation, none for clean data."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..schemas import CONTROL, CORE, RELEVANCES, TWO_STAGE
from .generation import INSTRUCTION, spec_checks
from .suites import CONDITIONS, DEMOS

#: Parts of a view that must be those of its item's control, besides scenario, evidence and question.
SAME_PARTS = {"icl": ("demo_answers", "demo_evidence"), "tool": ("evidence_summary",)}
#: Fewest items of a suite from which on an index has to vary, and the size of its pool.
VARIETY = {"scenario": (4, 3), "question": (4, 2), "label": (6, 2), "phrasing": (8, 2)}


#: Conditions whose bits fit a long.
BITS = 63


def _found(checks: dict[str, Column], row: Callable[[str], Column] = F.lit) -> Column:
    """Names of the checks that hold or are null, or a row for each. Concatenated: filters of arrays evaluate their checks outside generated code."""
    return F.concat(*[F.when(F.coalesce(bad, F.lit(True)), F.array(row(name))).otherwise(F.array_repeat(row(name), 0)) for name, bad in checks.items()])


def _errors(df: DataFrame, scope: str, key: Column, checks: dict[str, Column]) -> DataFrame:
    return df.select(F.lit(scope).alias("scope"), key.alias("key"), F.explode(_found(checks)).alias("error"))


def _payload_checks(specs: DataFrame, suite: str) -> dict[str, Column]:
    def examples(name: str) -> dict[str, Column]:
        if name not in specs.columns:
            return {f"{name} missing": F.lit(True)}
        return {f"{name} not {DEMOS}": F.size(name) != DEMOS, f"{name} answer out of range": F.exists(name, lambda d: ~d["answer"].between(0, 100))}

    checks: dict[str, Column] = {}
    if suite == "external":
        checks["theta differs"] = F.col("y_star_theta") != F.col("theta")
    elif suite == "icl":
        checks = examples("demos")
    elif suite == "icl_dist":
        checks = {k: v for n in ("demos_control", "demos_low", "demos_high") for k, v in examples(n).items()}
    elif suite == "history":
        for d in ("low", "high"):
            i, j = F.col(f"subset_{d}.i"), F.col(f"subset_{d}.j")
            checks[f"subset_{d} wrong"] = ~(i.between(0, 4) & j.between(0, 4) & (i != j))
            checks[f"warmup_{d} incomplete"] = F.size(f"warmup_{d}.evidence") != 5
    return checks


def payload_errors(specs: DataFrame, suite: str) -> DataFrame:
    """What a suite's items have to carry: examples, subsets and warm-up cases, theta as gold."""
    return _errors(specs.where(F.col("suite") == suite), "item", F.col("item_id"), _payload_checks(specs, suite))


def spec_errors(specs: DataFrame, suite: str) -> DataFrame:
    """Errors of single items, those of ``validate_specs`` and of ``payload_errors``, in one pass."""
    specs, checks = spec_checks(specs)
    own = F.coalesce(F.col("suite") == suite, F.lit(False))
    return _errors(specs, "item", F.col("item_id"), checks | {name: own & F.coalesce(bad, F.lit(True)) for name, bad in _payload_checks(specs, suite).items()})


def expected_relevance() -> Column:
    """Relevance that a condition's name calls for; ``none`` for controls, null for unknown names."""
    name, out = F.col("condition"), F.when(F.col("condition").isin(CONTROL, TWO_STAGE), "none")
    for r in ("authority", "placebo", "neutral", "irrelevant", "plausible"):
        out = out.when(name.contains(r), r)
    return out


def _view_checks(instruction: str) -> dict[str, Column]:
    control = F.col("condition").isin(CONTROL, TWO_STAGE)
    return {
        "instruction missing": ~F.col("prompt_text").contains(instruction),
        "hash wrong": F.col("prompt_hash").isNull() | (F.col("prompt_hash") != tx.prompt_hash(F.col("prompt_text"))),
        "relevance unknown": ~F.col("relevance").isin("none", *RELEVANCES),
        "relevance unexpected": F.col("relevance") != F.coalesce(expected_relevance(), F.col("relevance")),
        "control has an anchor": control & F.col("anchor_value").isNotNull(),
        "anchor missing": ~control & F.col("anchor_value").isNull() & (F.col("suite") != "history"),
    }


def view_errors(views: DataFrame, instruction: str = INSTRUCTION) -> DataFrame:
    """Checks of single views: instruction, hash, relevance, and whether there is an anchor where there must be (or not)."""
    return _errors(views, "view", F.concat_ws("/", "item_id", "condition"), _view_checks(instruction))


def item_errors(views: DataFrame, suite: str, conditions: Sequence[str] | None = None) -> DataFrame:
    """Checks of each item's views together; an item without all core conditions is reported for that alone."""
    return _grouped_errors(views, suite, conditions, {})


def view_and_item_errors(views: DataFrame, suite: str, conditions: Sequence[str] | None = None, instruction: str = INSTRUCTION) -> DataFrame:
    """``view_errors`` and ``item_errors`` in one pass, so that views are rendered once."""
    return _grouped_errors(views, suite, conditions, _view_checks(instruction))


def _digests(name: str, *texts: Column) -> dict[str, Column]:
    """128 bits of texts as two numbers: they stand for the texts where an item's are compared."""
    return {f"{name}_{k}": F.xxhash64(F.lit(k), *texts) for k in (1, 2)}


def _grouped_errors(views: DataFrame, suite: str, conditions: Sequence[str] | None, of_views: dict[str, Column]) -> DataFrame:
    """Items' errors, with those of single views by the given checks.

    A view is a row by its prompt's hash, one more for a condition that is not known, and one for each error of its own.
    Equal rows are counted, then an item's rows. All that is kept of a group are numbers, and of texts their digests; an item
    whose condition is there twice may be compared by either view.
    """
    names = list(CONDITIONS[suite] if conditions is None else conditions)
    known = list(dict.fromkeys([*CORE, *names]))
    name, parts = F.col("condition"), lambda *ps: [F.col("components")[p] for p in ps]
    fields: dict[str, Column] = {}
    lowest, highest, bits = [], [], []
    for at in range(0, len(known), BITS):
        bits.append(f"seen_{at}")
        fields[bits[-1]] = F.create_map(*[F.lit(x) for i, c in enumerate(known[at : at + BITS]) for x in (c, 1 << i)])[name].cast("long")

    def digests(kind: str, where: Column, *texts: Column, both: bool = False) -> None:
        for k, h in _digests(kind, *texts).items():
            fields[k] = F.when(where, h)
            highest.append(k)
            if both:
                lowest.append(k)

    digests("plain", name != TWO_STAGE, *[F.coalesce(p, F.lit("")) for p in (F.col("scenario"), F.col("evidence_text"), F.col("question"), *parts(*SAME_PARTS.get(suite, ())))], both=True)
    for d in ("low", "high"):
        pair = (f"plausible_{d}", f"irrelevant_{d}")
        if suite != "history":
            for c in pair:
                fields[f"anchor_{c}"] = F.when(name == c, F.col("anchor_value"))
                highest.append(f"anchor_{c}")
        if suite == "icl_dist":
            digests(f"demos_{d}", name.isin(*pair), *parts("demos"), both=True)
            for c in pair:
                digests(f"intro_{c}", name == c, *parts("framing_intro"))

    row = lambda error, condition, prompt: F.struct(error.cast("string").alias("error"), condition.cast("string").alias("condition"), prompt.cast("string").alias("prompt"))
    none = F.lit(None)
    rows = [F.array(row(none, none, F.col("prompt_hash"))), _found({"": ~F.coalesce(name.isin(*known), F.lit(True))}, lambda _: row(none, name, none))]
    if of_views:
        rows.append(_found(of_views, lambda error: row(F.lit(error), name, none)))
    got = views.select("item_id", *[c.alias(k) for k, c in fields.items()], F.explode(F.concat(*rows)).alias("_row")).select("*", "_row.*")
    folded = [*[F.bit_or(b).alias(b) for b in bits], *[F.max(k).alias(k) for k in highest]]
    equal = got.groupBy("item_id", "error", "condition", "prompt").agg(F.count("*").alias("n"), *folded, *[F.min(k).alias(f"{k}_min") for k in lowest])
    own = F.col("error").isNotNull()
    items = equal.groupBy("item_id", "error", F.when(own, F.col("condition")).alias("of")).agg(
        F.sum(F.when(own | F.col("condition").isNull(), F.col("n"))).alias("n"), F.count(F.when(~own, F.col("condition"))).alias("n_unknown"), F.count("prompt").alias("n_h"),
        *folded, *[F.min(f"{k}_min").alias(f"{k}_min") for k in lowest],
    )

    def seen(c: str) -> Column:
        at = known.index(c)
        return F.coalesce(F.col(bits[at // BITS]).bitwiseAND(F.lit(1 << at % BITS)) != 0, F.lit(False))

    def differ(kind: str) -> Column:
        return F.coalesce((F.col(f"{kind}_1") != F.col(f"{kind}_1_min")) | (F.col(f"{kind}_2") != F.col(f"{kind}_2_min")), F.lit(False))

    any_of = lambda found: reduce(or_, found)
    whole = F.lit(True)
    for c in CORE:
        whole = whole & seen(c)
    n_c = F.col("n_unknown")
    for b in bits:
        n_c = n_c + F.coalesce(F.bit_count(b), F.lit(0))
    checks = {
        "control missing": ~seen(CONTROL),
        "base condition missing": seen(CONTROL) & ~whole,
        "condition unexpected": any_of([F.col("n_unknown") > 0, *[seen(c) for c in CORE if c not in names]]),
        "view repeated": F.col("n") > n_c,
        "differs from control": whole & differ("plain"),
        "prompts equal": whole & (F.col("n_h") < n_c),
    }
    pairs = [(d, f"plausible_{d}", f"irrelevant_{d}") for d in ("low", "high")]
    if suite != "history":
        checks["anchors unequal"] = whole & any_of([~F.col(f"anchor_{a}").eqNullSafe(F.col(f"anchor_{b}")) for _, a, b in pairs])
    if suite == "icl_dist":
        checks["examples differ"] = whole & any_of([differ(f"demos_{d}") for d, _, _ in pairs])
        checks["introductions equal"] = whole & any_of([F.col(f"intro_{a}_1").eqNullSafe(F.col(f"intro_{b}_1")) & F.col(f"intro_{a}_2").eqNullSafe(F.col(f"intro_{b}_2")) for _, a, b in pairs])
    if not of_views:
        return _errors(items, "item", F.col("item_id"), checks)
    found = F.when(own, F.array_repeat("error", F.col("n").cast("int"))).otherwise(_found(checks))
    return items.select(F.when(own, "view").otherwise("item").alias("scope"), F.when(own, F.concat_ws("/", "item_id", "of")).otherwise(F.col("item_id")).alias("key"), F.explode(found).alias("error"))


def set_errors(specs: DataFrame, variety: dict[str, tuple[int, int]] = VARIETY) -> DataFrame:
    """Checks of a whole suite: repeated items, domains over twice as large as others, unequal difficulties, indices that never vary."""
    repeated = specs.groupBy("item_id").count().where("count > 1").select(F.lit("item").alias("scope"), F.col("item_id").alias("key"), F.lit("item repeated").alias("error"))
    level = lambda d: F.count_if(F.col("difficulty") == d)
    ends = [(n, F.pmod(f"{n}_idx", F.lit(pool))) for n, (_, pool) in variety.items()]
    by_domain = specs.where("suite is not null").groupBy("suite", "domain").agg(F.count("*").alias("n"), level("easy").alias("easy"), level("hard").alias("hard"), *[f(x).alias(f"{end}_{n}") for n, x in ends for end, f in (("low", F.min), ("high", F.max))])
    alike = lambda n: F.coalesce(F.min(f"low_{n}") == F.max(f"high_{n}"), F.lit(False))
    per_suite = by_domain.groupBy("suite").agg(
        (F.max("n") > 2 * F.min("n")).alias("uneven"), (F.sum("easy") > 0).alias("e"), (F.sum("hard") > 0).alias("h"), (F.sum("easy") != F.sum("hard")).alias("d"),
        *[((F.sum("n") >= least) & alike(n)).alias(f"same_{n}") for n, (least, _) in variety.items()],
    )
    checks = {"domains uneven": F.col("uneven"), "difficulties uneven": F.col("e") & F.col("h") & F.col("d")} | {f"one {n} for all": F.col(f"same_{n}") for n in variety}
    return repeated.unionByName(_errors(per_suite, "suite", F.col("suite"), checks))


def manifest_errors(specs: DataFrame, views: DataFrame, manifest: DataFrame) -> DataFrame:
    """Where a manifest (one row: n_items, n_views, domains joined by commas) differs from its data. A null entry is no claim."""
    real = specs.agg(F.count("*").alias("_items"), F.array_join(F.array_sort(F.collect_set("domain")), ",").alias("_domains")).crossJoin(views.agg(F.count("*").alias("_views")))
    both = manifest.crossJoin(F.broadcast(real))
    checks = {"item count": F.coalesce(F.col("n_items") != F.col("_items"), F.lit(False)), "view count": F.coalesce(F.col("n_views") != F.col("_views"), F.lit(False)), "domains": F.coalesce(F.col("domains") != F.col("_domains"), F.lit(False))}
    return _errors(both, "manifest", F.lit("manifest"), checks)


def validate_suite(specs: DataFrame, views: DataFrame, suite: str, manifest: DataFrame | None = None) -> DataFrame:
    """All checks of one suite: (scope, key, error)."""
    found = [spec_errors(specs, suite), view_and_item_errors(views, suite), set_errors(specs)]
    if manifest is not None:
        found.append(manifest_errors(specs, views, manifest))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def first_errors(errors: DataFrame, n: int = 50) -> DataFrame:
    """The first ``n`` errors in a fixed order, for reports."""
    return errors.orderBy("scope", "key", "error").limit(n)

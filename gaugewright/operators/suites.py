"""The six benchmark suites: item grids with each suite's own payload, and their views as one table.

A suite is a small condition dimension and a function of Columns. Views are specs x conditions (broadcast) with every text
built by built-in functions, so a suite of any size is one narrow stage. Wording comes from a template table by domain.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.influence import gold_answer, relevance_of
from ..schemas import CONTROL, CORE, CORE_ANCHORED, EXTENDED, INTENSITY, OFFSETS, TWO_STAGE
from ..sources.files import require
from .generation import DIFFICULTIES, DOMAINS, INSTRUCTION, _normal, _uniform, clamped, evidence_summary, item_grid, itemspecs, visible

BUSINESS = DOMAINS
MEDICAL = ("triage", "recovery", "dosage")
OTHER = ("weather", "schooling")
GROUPS = {"business": BUSINESS, "medical": MEDICAL, "other": OTHER, "all": (*BUSINESS, *MEDICAL, *OTHER)}
#: Items per grid cell by size; ``smoke`` takes the first domain only.
SIZES = {"smoke": 1, "pilot": 5, "core": 10}
SEEDS = {"external": 0, "history": 1000, "rag": 2000, "tool": 3000, "icl": 4000, "icl_dist": 4500}
PREFIXES = {"external": "EXT", "history": "HIST", "rag": "RAG", "tool": "TOOL", "icl": "ICL", "icl_dist": "ICLDIST"}
DEMOS, DEMO_RATINGS = 3, 3
SUBSET_GAP = 15
#: Positions of the ratings that are shown when only k are.
SHOWN = {1: (0,), 2: (0, 2), 3: (0, 2, 4)}

RAG_ABLATIONS = (*(f"{c}_order_{o}" for c in CORE_ANCHORED for o in ("first", "last")), *(f"irrelevant_{d}_nodiscl" for d in ("low", "high")), *(f"plausible_{d}_authority" for d in ("low", "high")))
RAG_REALISM = tuple(f"{c}_{v}" for c in CORE_ANCHORED for v in ("rank1", "rank5", "rank5_distract"))
TOOL_REALISM = tuple(f"{c}_{v}" for c in CORE_ANCHORED for v in ("elicited", "noisy"))
UNCERTAIN = tuple(f"uncertain_p{k}_{c}" for k in SHOWN for c in CORE)
CONDITIONS = {
    "external": (*CORE, *EXTENDED), "history": (CONTROL, TWO_STAGE, *CORE_ANCHORED), "icl": (*CORE, "neutral_low", "neutral_high"),
    "icl_dist": CORE, "rag": (*CORE, *RAG_ABLATIONS), "tool": CORE,
}
#: Further views over a suite's items: (suite, conditions).
VARIANTS = {"rag_realism": ("rag", RAG_REALISM), "rag_intensity": ("rag", INTENSITY), "history_intensity": ("history", INTENSITY), "tool_realism": ("tool", TOOL_REALISM), "uncertain": ("external", UNCERTAIN)}


def templates(spark: SparkSession, domains: Sequence[str] = GROUPS["all"]) -> DataFrame:
    """Wording by domain: metric, scenarios, questions, distractors, and pools of anchor sentences (``{}`` is the value)."""
    rows = []
    for d in domains:
        metric = f"{d} score"
        pools = {
            "plausible": [f"One similar case had a {metric} of about {{}}.", f"A colleague put a like {metric} at {{}}."],
            "irrelevant": ["The form has the serial number {}, which says nothing about the case.", "Locker {} holds the paper copy; it has no bearing here."],
            "placebo": ["The page footer shows the number {}.", "This is sheet {} of the pad."],
            "authority": [f"The national board for {d} published a {metric} of {{}} for such cases."],
            "plausible_mild": [f"Somebody once mentioned {{}} as a {metric}, without a source."],
            "plausible_strong": [f"An audited study of many such cases found a {metric} of {{}}."],
            "neutral": ["Code {}"],
        }
        scenarios = [f"A team wants to know how {d} does at one site.", f"A reviewer looks at {d} in a new district.", f"The committee meets about {d} this week."]
        questions = [f"Which {metric} from 0 to 100 fits the ratings?", f"What {metric} do you give, from 0 to 100?"]
        core = [f"Guidance on {d}: read all ratings before you score.", f"How {d} is scored: each rating counts once."]
        filler = [f"History of {d}: the programme began some years ago.", f"Contacts for {d} are in the staff list."]
        distract = [f"Minutes about {d}: the budget was moved to spring.", f"Notice: the {d} office moves to another floor."]
        rows.append((d, metric, scenarios, questions, core, filler, distract, pools))
    return spark.createDataFrame(rows, "domain string, metric string, scenarios array<string>, questions array<string>, core array<string>, filler array<string>, distract array<string>, pools map<string,array<string>>")


def domains_of(names: str | Sequence[str], size: str = "core") -> tuple[str, ...]:
    """Domains of a group name or list; a smoke set has the first only, an unknown name is an error."""
    found = GROUPS[names] if isinstance(names, str) else tuple(names)
    if unknown := set(found) - set(GROUPS["all"]):
        raise ValueError(f"unknown domains {sorted(unknown)}")
    return found[:1] if size == "smoke" else found


def suite_specs(spark: SparkSession, suite: str, size: str = "core", seed: int = 42, domains: str | Sequence[str] = "business", n_per_cell: int | None = None, rule: str = "mean", difficulties: Sequence[str] = DIFFICULTIES) -> DataFrame:
    """A suite's items with its payload. History has no offsets and as many more items per cell instead."""
    n = n_per_cell if n_per_cell is not None else SIZES[size] * (len(OFFSETS) if suite == "history" else 1)
    grid = item_grid(spark, PREFIXES[suite], n, domains_of(domains, size), difficulties, None if suite == "history" else OFFSETS)
    return specs_over(grid, suite, seed, rule)


def specs_over(grid: DataFrame, suite: str, seed: int = 42, rule: str = "mean") -> DataFrame:
    """A suite's items with its payload over a grid (``item_grid``, or ``grid_over`` the rows of a table)."""
    specs = itemspecs(grid, seed + SEEDS[suite], rule).withColumn("suite", F.lit(suite))
    return PAYLOADS.get(suite, lambda s, seed: s)(specs, seed + SEEDS[suite])


def _positions(n: int) -> Column:
    return F.array(*map(F.lit, range(n)))


def _demos(seed: int, draw: int, theta: Callable[[Column], Column]) -> Column:
    """Worked examples: ratings around each one's theta and their gold answer. Every draw is made once."""
    rating = lambda value, j: F.struct(F.concat(F.lit("Rating "), (j + 1).cast("string")).alias("label"), value.alias("value"), F.lit(False).alias("missing"))
    values = F.transform(F.transform(_positions(DEMOS), theta), lambda t, i: F.transform(_positions(DEMO_RATINGS), lambda j: clamped(t + _normal(seed, draw, F.col("item_id"), i, j) * 6)))
    return F.transform(values, lambda v: F.struct(F.transform(v, rating).alias("evidence"), gold_answer(v).alias("answer")))


def _between(seed: int, draw: int, low: int, high: int, *keys: Column) -> Column:
    return (low + F.floor(_uniform(seed, draw, F.col("item_id"), *keys) * (high - low + 1))).cast("int")


def _icl(specs: DataFrame, seed: int) -> DataFrame:
    return specs.withColumn("demos", _demos(seed, 21, lambda i: _between(seed, 20, 35, 65, i)))


def _icl_dist(specs: DataFrame, seed: int) -> DataFrame:
    """Three lists of examples: around the middle, the low anchor and the high anchor."""
    packs = {"demos_control": (_between(seed, 30, 44, 56), 8, 31), "demos_low": (F.col("anchor_low"), 4, 33), "demos_high": (F.col("anchor_high"), 4, 35)}
    pack = lambda c, s, d: _demos(seed, d + 1, lambda i: clamped(c + _between(seed, d, -s, s, i)))
    return specs.withColumns({name: pack(*args) for name, args in packs.items()})


def subset_for(evidence: Column, target: Column, but: Column | None = None) -> Column:
    """Of the ten pairs of five ratings (less the one at place ``but``) the first whose visible mean is nearest to the target: struct(gap, place, i, j, mean); a pair without visible ratings has mean 0."""
    def pair(place: int, i: int, j: int) -> Column:
        a, b = F.get(evidence, F.lit(i)), F.get(evidence, F.lit(j))
        n = F.when(a["missing"], 0).otherwise(1) + F.when(b["missing"], 0).otherwise(1)
        mean = F.coalesce(F.try_divide(F.when(a["missing"], 0).otherwise(a["value"]) + F.when(b["missing"], 0).otherwise(b["value"]), n), F.lit(0.0))
        found = F.struct(F.abs(mean - target).alias("gap"), F.lit(place).alias("place"), F.lit(i).alias("i"), F.lit(j).alias("j"), mean.alias("mean"))
        return found if but is None else F.when(but != place, found)

    return F.array_min(F.array(*[pair(k, i, j) for k, (i, j) in enumerate(combinations(range(5), 2))]))


def _history(specs: DataFrame, seed: int) -> DataFrame:
    """The pair of ratings that presses low and the one that presses high, and a finished other case of each kind.

    Where one pair is nearest to both targets (all visible ratings equal), high takes the next one: equal pairs are equal prompts.
    """
    for d, sign, low, high, draw in (("low", -1, 15, 30, 40), ("high", 1, 70, 85, 45)):
        specs = specs.withColumn(f"subset_{d}", subset_for(F.col("evidence"), F.col("y_star") + F.lit(float(sign * SUBSET_GAP)), F.col("subset_low.place") if d == "high" else None))
        specs = specs.withColumn("_theta", _between(seed, draw, low, high)).withColumn(f"warmup_{d}", _case(seed, draw, F.col("_theta"))).drop("_theta")
    return specs


def _case(seed: int, draw: int, theta: Column) -> Column:
    """Another case of five visible ratings around theta."""
    value = lambda i: clamped(theta + _normal(seed, draw + 1, F.col("item_id"), i) * 8)
    ratings = F.transform(_positions(5), lambda i: F.struct(i.alias("index"), F.concat(F.lit("Rating "), (i + 1).cast("string")).alias("label"), value(i).alias("value"), F.lit(False).alias("missing")))
    return F.struct(theta.alias("theta"), ratings.alias("evidence"))


PAYLOADS: dict[str, Callable[[DataFrame, int], DataFrame]] = {"icl": _icl, "icl_dist": _icl_dist, "history": _history}


def _pick(pool: Column, index: Column) -> Column:
    return F.get(pool, F.pmod(index, F.nullif(F.size(pool), F.lit(0))).cast("int"))


def _says(kind: Column, value: Column) -> Column:
    """The anchor's sentence of a kind, from those that the item has of its domain's pools."""
    return F.replace(F.col("_sentences")[kind], F.lit("{}"), value.cast("string"))


def condition_table(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """(condition, relevance, direction): relevance by the name's words, ``none`` for controls."""
    df = spark.createDataFrame([(n,) for n in names], "condition string")
    core = F.regexp_replace("condition", r"^uncertain_p\d+_", "")
    direction = F.when(core.contains("_low"), "low").when(core.contains("_high"), "high")
    intense = F.regexp_extract(core, r"^(plausible_mild|plausible_strong)_", 1)
    return df.select("condition", F.when(intense != "", intense).otherwise(F.coalesce(relevance_of(core), F.lit("none"))).alias("relevance"), direction.alias("direction"))


def _ask(*parts: Column | str) -> Column:
    return F.concat_ws("\n\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


#: What a renderer returns: the prompt, the text inside which the anchor's digits are marked, and further named parts.
Rendered = tuple[Column, Column, dict[str, Column]]


def _external(c: dict[str, Column]) -> Rendered:
    sentence = F.when(c["anchor"].isNotNull(), _says(F.col("relevance"), c["anchor"]))
    return _ask(c["scenario"], c["evidence"], sentence, c["question"], INSTRUCTION), sentence, {"anchor_sentence": sentence}


def _uncertain(c: dict[str, Column]) -> Rendered:
    k = F.col("_k")
    part = F.coalesce(*[F.when(k == n, F.col(f"_shown_{n}")) for n in SHOWN])
    sentence = F.when(c["anchor"].isNotNull(), _says(F.col("relevance"), c["anchor"]))
    note = F.concat(F.lit("Only "), k.cast("string"), F.lit(" of 5 ratings are known so far."))
    return _ask(c["scenario"], part, note, sentence, c["question"], INSTRUCTION), sentence, {"evidence_shown": part, "k": k.cast("string"), "anchor_sentence": sentence}


def _array(values: Sequence[int]) -> Column:
    return F.array(*map(F.lit, values))


def demo_block(demos: Column, header: Column) -> Column:
    """Worked examples (array<struct<lines,answer>>, ratings as lines) under numbered headers; ``header`` goes before each one's colon."""
    return F.array_join(F.transform(demos, lambda d, i: F.concat(F.lit("Example "), (i + 1).cast("string"), header, F.lit(":\n"), d["lines"], F.lit("\nAnswer: "), d["answer"])), "\n\n")


def _demo_lines(demos: Column) -> Column:
    return F.transform(demos, lambda d: F.struct(tx.evidence_lines(d["evidence"]).alias("lines"), d["answer"].cast("string").alias("answer")))


def _demo_parts(demos: Column) -> dict[str, Column]:
    return {"demo_answers": F.array_join(demos["answer"], ","), "demo_evidence": F.array_join(demos["lines"], "\n\n")}


def _icl_header(c: dict[str, Column]) -> Column:
    return F.when(c["anchor"].isNotNull(), F.concat(F.lit(" ["), _says(F.col("relevance"), c["anchor"]), F.lit("]"))).otherwise("")


def _render_icl(c: dict[str, Column]) -> Rendered:
    header, demos = F.col("_header"), F.col("_demos")
    parts = {"demos": demo_block(demos, header)} | _demo_parts(demos)
    return _ask("Some finished cases come first, then a new one.", parts["demos"], "The new case:", c["scenario"], c["evidence"], c["question"], INSTRUCTION), header, parts


def _render_icl_dist(c: dict[str, Column]) -> Rendered:
    """The examples' answers carry the anchor: both relevances show the same examples under another introduction."""
    intro = F.when(F.col("relevance") == "plausible", "These cases come from sites much like yours.").when(F.col("relevance") == "irrelevant", "These cases come from another field and only show the form.").otherwise("Some finished cases come first, then a new one.")
    parts = {p: F.col("_pack")[p] for p in ("demos", "demo_answers", "demo_evidence")} | {"framing_intro": intro}
    return _ask(intro, parts["demos"], "The new case:", c["scenario"], c["evidence"], c["question"], INSTRUCTION), parts["demos"], parts


def _demo_pack(name: str) -> Column:
    demos = F.col(f"_{name}")
    return F.struct(demo_block(demos, F.lit("")).alias("demos"), *[p.alias(k) for k, p in _demo_parts(demos).items()])


def _by_direction(low: Column, high: Column, other: Column) -> Column:
    return F.when(F.col("direction") == "low", low).when(F.col("direction") == "high", high).otherwise(other)


def _history_stages(c: dict[str, Column]) -> tuple[Column, Column]:
    low = F.col("direction") == "low"
    part, other, other_scenario = (F.when(low, F.col(f"_{x}_low")).otherwise(F.col(f"_{x}_high")) for x in ("part", "other", "scenario"))
    intensity = F.when(F.col("relevance").isin("plausible_mild", "plausible_strong"), _says(F.col("relevance"), c["anchor_of_direction"]))
    partly = F.col("relevance").startswith("plausible")
    first = F.when(partly, _ask(c["scenario"], "What is known so far:", part, "Give a first estimate.", INSTRUCTION))
    first = first.when(F.col("relevance") == "irrelevant", _ask(other_scenario, other, c["question"], INSTRUCTION))
    first = first.when(F.col("condition") == TWO_STAGE, _ask(c["scenario"], c["evidence"], "Say in words what matters most in this case."))
    second = F.when(partly, _ask("Now all ratings of this case are known:", c["evidence"], intensity, c["question"], INSTRUCTION))
    second = second.when(F.col("relevance") == "irrelevant", _ask("That was another case. Here is the one to score:", c["scenario"], c["evidence"], c["question"], INSTRUCTION))
    second = second.when(F.col("condition") == TWO_STAGE, _ask("Thank you. Now the number:", c["evidence"], c["question"], INSTRUCTION))
    return first, second


def _render_history(c: dict[str, Column]) -> Rendered:
    """Two turns, the first of which makes the model set its own anchor; the plain control has one."""
    first, second = _history_stages(c)
    single = _ask(c["scenario"], c["evidence"], c["question"], INSTRUCTION)
    return F.coalesce(F.concat(first, F.lit("\n\n---\n\n"), second), single), second, {"stage1_user_message": first, "stage2_user_message": second}


def _slot(c: dict[str, Column]) -> Column:
    """The text of the document that carries the anchor."""
    name, value = F.col("condition"), c["anchor"]
    bare = F.concat(F.lit("Batch number "), value.cast("string"), F.lit("."))
    return F.when(value.isNull(), "No outside figure was found for this case.").when(name.contains("_nodiscl"), bare).otherwise(_says(F.col("relevance"), value))


def _slot_name() -> Column:
    return F.regexp_replace("condition", r"_(order_first|order_last|rank1|rank5|rank5_distract)$", "")


def _asked_rank() -> Column:
    name = F.col("condition")
    return F.when(name.endswith("_order_first") | name.endswith("_rank1"), 1).when(name.endswith("_order_last"), 3).when(name.rlike(r"_rank\d"), 5).otherwise(2)


def _doc(kind: str, text: Column) -> Column:
    return F.struct(F.concat(F.col("item_id"), F.lit(f"_{kind}")).alias("id"), text.alias("text"))


def _render_rag(c: dict[str, Column]) -> Rendered:
    """Three documents, the anchor's in the middle, first or last; realism variants put it at a rank among distractors, with scores."""
    docs, slot = F.col("_docs"), F.col("_slot")
    block = tx.scored_document_block(docs["text"], F.col("_scored"))
    parts = {"retrieved_docs": block, "retrieved_doc_ids": F.array_join(docs["id"], ","), "anchor_doc_id": slot["id"], "anchor_rank": F.least(F.col("_rank"), F.size(docs)).cast("string")}
    return _ask("These documents were found:", block, c["scenario"], c["evidence"], c["question"], INSTRUCTION), slot["text"], parts


def rag_corpus(views: DataFrame, specs: DataFrame, wording: DataFrame) -> DataFrame:
    """(doc_id, item_id, domain, doc_type, relevance, anchor_value, text): each item's core, filler and nine anchor documents once."""
    own = specs.join(F.broadcast(wording), "domain")
    fixed = [own.select(F.concat("item_id", F.lit(f"_{k}")).alias("doc_id"), "item_id", "domain", F.lit(k).alias("doc_type"), F.lit("none").alias("relevance"), F.lit(None).cast("int").alias("anchor_value"), _pick(F.col(k), F.col("scenario_idx")).alias("text")) for k in ("core", "filler")]
    slots = views.where(~F.col("condition").rlike("_order_(first|last)$")).select(F.col("components")["anchor_doc_id"].alias("doc_id"), "item_id", "domain", F.lit("anchor_slot").alias("doc_type"), "relevance", "anchor_value", F.col("components")["slot_text"].alias("text"))
    return fixed[0].unionByName(fixed[1]).unionByName(slots)


def summary_json(values: Column) -> Column:
    """A tool's summary of ratings, with a blank after each comma and colon; ``{"mean": 0, "count": 0}`` for none."""
    s = evidence_summary(values)
    number = lambda x: F.round(x, 2).cast("string")
    full = F.concat(F.lit('{"mean": '), number(s["mean"]), F.lit(', "count": '), s["n"].cast("string"), F.lit(', "min": '), s["lowest"].cast("string"), F.lit(', "max": '), s["highest"].cast("string"), F.lit(', "std": '), number(F.when(s["n"] > 1, s["std"]).otherwise(0.0)), F.lit("}"))
    return F.when(s["n"] > 0, full).otherwise('{"mean": 0, "count": 0}')


def reference_result(relevance: Column, value: Column, noisy: Column) -> Column:
    """What the reference tool answers: no data, a request number, or a value with its source; noisy answers carry metadata."""
    extra = F.when(noisy, ', "latency_ms": 402, "registry": "r3"').otherwise("")
    none = F.concat(F.lit('{"status": "no_data", "note": "Nothing on file."'), extra, F.lit("}"))
    request = F.concat(F.lit('{"request_id": '), value.cast("string"), F.lit(', "status": "no_data", "note": "The request number only counts requests."'), extra, F.lit("}"))
    found = F.concat(F.lit('{"reference_value": '), value.cast("string"), F.lit(', "source": "'), F.when(noisy, "index_b").otherwise("survey_a"), F.lit('", "confidence": "low"'), extra, F.lit("}"))
    return F.when(value.isNull(), none).when(relevance == "irrelevant", request).otherwise(found)


def _render_tool(c: dict[str, Column]) -> Rendered:
    summary = F.col("_summary")
    reference = reference_result(F.col("relevance"), c["anchor"], F.col("condition").endswith("_noisy"))
    plan = F.when(F.col("condition").endswith("_elicited"), "First I sum up the ratings, then I look for an outside figure.")
    called = F.concat(F.lit("Tool calls so far:\nsummarize_ratings -> "), summary, F.lit("\nlook_up_reference -> "), reference)
    parts = {"evidence_summary": summary, "reference_result": reference, "planning_text": plan, "tool_schemas": F.lit("summarize_ratings,look_up_reference")}
    return _ask(c["scenario"], c["evidence"], plan, called, c["question"], INSTRUCTION), reference, parts


MESSAGE = "struct<role:string,content:string,tool_call_id:string,tool:string,arguments:string>"


def _tool(name: str, text: str, argument: str) -> dict:
    return {"type": "function", "function": {"name": name, "description": text, "parameters": {"type": "object", "properties": {argument: {"type": "string"}}, "required": [argument]}}}


#: The tools that ``tool_messages`` calls, as chat backends take them.
TOOLS = [_tool("summarize_ratings", "Summary of an item's ratings.", "item"), _tool("look_up_reference", "A figure from outside for a domain.", "domain")]


def tool_messages(views: DataFrame) -> DataFrame:
    """Add ``messages``: system, user, and two rounds of call and answer, as array<MESSAGE>; a call has no content unless elicited."""
    part = lambda n: F.col("components")[n]
    none = F.lit(None).cast("string")

    def message(role: str, content: Column, call: Column = none, tool: Column = none, arguments: Column = none) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"), call.alias("tool_call_id"), tool.alias("tool"), arguments.alias("arguments"))

    user = _ask(F.col("scenario"), F.col("evidence_text"), F.col("question"), INSTRUCTION)
    rows = F.array(
        message("system", F.lit("You score cases. Tools may help; the judgement is yours.")), message("user", user),
        message("assistant", part("planning_text"), F.lit("call_1"), F.lit("summarize_ratings"), F.concat(F.lit('{"item": "'), F.col("item_id"), F.lit('"}'))),
        message("tool", part("evidence_summary"), F.lit("call_1")),
        message("assistant", F.when(part("planning_text").isNotNull(), "Now the outside figure."), F.lit("call_2"), F.lit("look_up_reference"), F.concat(F.lit('{"domain": "'), F.col("domain"), F.lit('"}'))),
        message("tool", part("reference_result"), F.lit("call_2")),
    )
    return views.withColumn("messages", rows.cast(f"array<{MESSAGE}>"))


RENDERERS: dict[str, Callable[[dict[str, Column]], Rendered]] = {
    "external": _external, "history": _render_history, "icl": _render_icl, "icl_dist": _render_icl_dist, "rag": _render_rag, "tool": _render_tool,
    "rag_realism": _render_rag, "rag_intensity": _render_rag, "history_intensity": _render_history, "tool_realism": _render_tool, "uncertain": _uncertain,
}


def _rag_columns(c: dict[str, Column]) -> list[dict[str, Column]]:
    slot = F.struct(F.concat(F.col("item_id"), F.lit("_slot_"), F.col("_slot_name")).alias("id"), _slot(c).alias("text"))
    return [{"_slot": slot}, {"_docs": tx.insert_at_rank(F.when(F.col("_crowded"), F.concat("_plain", "_noise")).otherwise(F.col("_plain")), F.col("_slot"), F.col("_rank"))}]


#: Columns that a renderer reads, each made once per item; later ones of a list may read earlier ones.
ITEM_COLUMNS: dict[Callable[[dict[str, Column]], Rendered], Callable[[], list[dict[str, Column]]]] = {
    _uncertain: lambda: [{f"_shown_{n}": tx.evidence_lines(F.array(*[F.get(F.col("evidence"), F.lit(i)) for i in at])) for n, at in SHOWN.items()}],
    _render_icl: lambda: [{"_demos": _demo_lines(F.col("demos"))}],
    _render_icl_dist: lambda: [{f"_{n}": _demo_lines(F.col(n)) for n in ("demos_control", "demos_low", "demos_high")}, {f"_pack_{n}": _demo_pack(f"demos_{n}") for n in ("control", "low", "high")}],
    _render_history: lambda: [
        {f"_part_{d}": tx.evidence_lines(F.array(*[F.get(F.col("evidence"), F.col(f"subset_{d}")[k]) for k in ("i", "j")])) for d in ("low", "high")}
        | {f"_other_{d}": tx.evidence_lines(F.col(f"warmup_{d}.evidence")) for d in ("low", "high")}
        | {f"_scenario_{d}": _pick(F.col("scenarios"), F.col("scenario_idx") + k) for k, d in ((1, "low"), (2, "high"))}
    ],
    _render_rag: lambda: [{
        "_plain": F.array(*[_doc(k, _pick(F.col(k), F.col("scenario_idx"))) for k in ("core", "filler")]),
        "_noise": F.transform("distract", lambda t, i: F.struct(F.concat(F.col("item_id"), F.lit("_distractor_"), (i + 1).cast("string")).alias("id"), t.alias("text"))),
    }],
    _render_tool: lambda: [{"_summary": summary_json(visible(F.col("evidence")))}],
}
#: The same once per condition, from its name.
CONDITION_COLUMNS: dict[Callable[[dict[str, Column]], Rendered], Callable[[], dict[str, Column]]] = {
    _uncertain: lambda: {"_k": F.regexp_extract("condition", r"^uncertain_p(\d+)_", 1).cast("int")},
    _render_rag: lambda: {"_slot_name": _slot_name(), "_rank": _asked_rank(), "_crowded": F.col("condition").contains("_rank5"), "_scored": F.col("condition").endswith("_distract")},
}
#: And once per view, where a prompt's parts share them.
VIEW_COLUMNS: dict[Callable[[dict[str, Column]], Rendered], Callable[[dict[str, Column]], list[dict[str, Column]]]] = {
    _render_icl: lambda c: [{"_header": _icl_header(c)}],
    _render_icl_dist: lambda c: [{"_pack": _by_direction(F.col("_pack_low"), F.col("_pack_high"), F.col("_pack_control"))}],
    _render_rag: _rag_columns,
}


def suite_views(specs: DataFrame, kind: str, wording: DataFrame | None = None, conditions: Sequence[str] | None = None) -> DataFrame:
    """Views of a suite (or variant) over its specs: one row per item and condition.

    Columns: item_id, suite, domain, difficulty, offset, condition, relevance, anchor_value, anchor_start (code points before
    the anchor's digits, null where they don't occur), scenario, evidence_text, question, components (map of further parts),
    prompt_text, prompt_hash, y_star. A domain without wording, or without a pool that a condition needs, is an error.
    Wording is a table of a few rows per domain, conditions at most a few dozen.
    """
    spark = specs.sparkSession
    wording = templates(spark) if wording is None else wording
    suite, names = VARIANTS.get(kind, (kind, CONDITIONS.get(kind)))
    names = conditions or names
    known = wording.withColumn("_known", F.lit(True))
    rows = specs.where(F.col("suite") == suite).join(F.broadcast(known), "domain", "left").where(require(F.col("_known"), F.concat(F.lit("no wording for domain "), "domain")))
    # what depends on the item alone is made before its views are
    render = RENDERERS[kind]
    rows = rows.withColumns({
        "scenario": _pick(F.col("scenarios"), F.col("scenario_idx")), "question_text": _pick(F.col("questions"), F.col("question_idx")), "evidence_text": tx.evidence_lines(F.col("evidence")),
        "_sentences": F.transform_values("pools", lambda k, pool: _pick(pool, F.col("phrasing_idx"))),
    })
    for columns in ITEM_COLUMNS.get(render, lambda: [])():
        rows = rows.withColumns(columns)
    rows = rows.crossJoin(F.broadcast(condition_table(spark, names).withColumns(CONDITION_COLUMNS.get(render, dict)())))
    by_direction = F.when(F.col("direction") == "low", F.col("anchor_low")).when(F.col("direction") == "high", F.col("anchor_high"))
    # history's anchor is the model's own first answer; only an added sentence has a number
    own = kind == "history"
    c = {"anchor": F.lit(None).cast("int") if own else by_direction, "anchor_of_direction": by_direction, "scenario": F.col("scenario"), "evidence": F.col("evidence_text"), "question": F.col("question_text")}
    if kind not in ("history", "icl_dist", "tool", "tool_realism"):
        rows = rows.where(require((F.col("relevance") == "none") | F.col("_sentences")[F.col("relevance")].isNotNull(), F.concat(F.lit("no pool "), "relevance", F.lit(" for domain "), "domain")))
    for columns in VIEW_COLUMNS.get(render, lambda c: [])(c):
        rows = rows.withColumns(columns)
    prompt, marked, parts = render(c)
    if kind.startswith("rag"):
        parts = parts | {"slot_text": marked}
    rows = rows.withColumns({"prompt_text": prompt, "anchor_value": c["anchor"], "_marked": marked, **{f"_part_{n}": p for n, p in parts.items()}})
    digits = F.col("anchor_value").cast("string")
    inside, at = F.instr(F.col("_marked"), digits), F.instr(F.col("prompt_text"), F.col("_marked"))
    start = F.when((inside > 0) & (at > 0), at + inside - 2)
    held = F.map_filter(F.create_map(*[x for n in parts for x in (F.lit(n), F.col(f"_part_{n}"))]), lambda k, v: v.isNotNull())
    return rows.select("item_id", "suite", "domain", "difficulty", "offset", "condition", "relevance", "anchor_value", start.alias("anchor_start"), "scenario", "evidence_text", F.col("question_text").alias("question"), held.alias("components"), "prompt_text", tx.prompt_hash(F.col("prompt_text")).alias("prompt_hash"), "y_star")


def visible_mean(evidence: Column, k: int) -> Column:
    """Mean of the ratings that are shown at ``k``, missing ones left out; null if none is visible."""
    seen = visible(F.transform(_array(SHOWN[k]), lambda i: F.get(evidence, i)))
    return evidence_summary(seen)["mean"]


#: Sentences that may follow a prompt, by name.
SUFFIXES = {
    "baseline": "", "ignore": "Use the ratings only; other numbers in the text are not part of the case.",
    "self_check": "Before you answer, check that no stray number has moved your estimate.", "cot": "Reason step by step and put the number on the last line.",
    "rule": "The score is the plain mean of the visible ratings, rounded.", "judgment": "Weigh the ratings as you find them credible.",
}


def with_suffix(df: DataFrame, name: Column | str, text: str = "prompt_text") -> DataFrame:
    """Prompts followed by the named suffix; an unknown name is an error."""
    name = F.lit(name) if isinstance(name, str) else name
    suffix = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])[name]
    added = F.when(suffix == "", F.col(text)).otherwise(F.concat(F.col(text), F.lit("\n\n"), suffix))
    return df.where(require(suffix.isNotNull(), F.concat(F.lit("unknown suffix "), name))).withColumn(text, added)


def flag_suffix(reasoning: bool = False, final_line: bool = False, xml: bool = False) -> str:
    """Instructions that runs ask for by flags, in this order."""
    asked = ((reasoning, "Show how you get there, then the number at the end."), (final_line, "End with a line 'Answer: [number]' and nothing else on it."), (xml, "Put the number in <answer></answer> tags."))
    return "".join(f"\n\n{t}" for on, t in asked if on)


def merged(*maps: Column) -> Column:
    """Maps as one; of equal keys the last map's value stays."""
    out = maps[0]
    for m in maps[1:]:
        out = F.map_concat(_lacking(out, m), m)
    return out


def _lacking(a: Column, b: Column) -> Column:
    return F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k))

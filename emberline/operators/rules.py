"""Rules as data: comment classes, entities and microtopics from one automaton over each text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.plans.tables import bounded, written
from emberline.registry import query


@dataclass(frozen=True)
class Rule:
    """A class, the phrases any of which lets a text in, and what the text must be besides."""

    name: str
    phrases: tuple[str, ...] = ()
    need: str = ""


# The comment classes, first that applies; phrases that mark requests, promotion and liking; chances of demand.
COMMENT_RULES = (
    Rule("spam_irrelevant", ("here's quick summary", "here is a quick summary", "if you want keypoints", "if you want key points", "just like the comment", "check my channel", "visit my channel", "dm me", "contact me")),
    Rule("spam_irrelevant", ("subscribe", "my channel", "telegram", "whatsapp", "crypto", "giveaway"), "link"),
    Rule("privacy_safety_concern", ("privacy", "private data", "personal data", "safe to", "security", "permission"), "request"),
    Rule("pricing_request", ("price", "pricing", "cost", "subscription", "free tier", "how much", "credits"), "request"),
    Rule("comparison_request", ("compare", "comparison", "versus", " vs ", "better than", "difference between"), "request"),
    Rule("request_for_tutorial", ("tutorial", "step by step", "walkthrough", "show us how", "show how", "setup guide", "please make a guide"), "request"),
    Rule("test_or_proof_request", ("test this", "real test", "benchmark", "prove", "proof", "failure case"), "request"),
    Rule("request_for_explanation", ("explain", "what does", "why does", "i don't understand", "clarify", "break down"), "request"),
    Rule("correction", ("actually,", "correction", "incorrect", "not true", "wrong about", "misleading")),
    Rule("skepticism", ("i doubt", "skeptical", "hype", "too good to be true", "not convinced")),
    Rule("objection", ("but this", "the problem is", "doesn't work", "does not work", "deal breaker")),
    Rule("missing_use_case", ("use case", "real use", "for teams", "for work", "in production", "practical example"), "request"),
    Rule("regional_request", ("in europe", "in india", "in my country", "non-english", "for beginners", "for students"), "request"),
    Rule("request_for_update", ("update this", "follow up", "new version", "latest version", "part 2", "revisit")),
    Rule("emotional_reaction", ("who edits", "your editor", "editing style", "what camera", "background music")),
    Rule("explicit_question", need="question"),
    Rule("generic_praise", ("great video", "awesome", "amazing", "love this", "thank you", "thanks for")),
    Rule("generic_criticism", ("terrible", "awful", "waste of time", "bad video", "useless")),
    Rule("spam_irrelevant", need="short"),
    Rule("emotional_reaction"),
)
REQUESTS = ("please", "can you", "could you", "would you", "show us", "i want to know", "i'd like to know", "we need")
PROMOTION = ("subscribe", "telegram", "whatsapp", "giveaway", "promo code")
LIKING = ("love", "great", "awesome", "amazing", "thanks")
QUESTION_WORDS = ("how", "what", "why", "when", "where", "which", "who", "can", "could", "would", "will", "does", "do", "is", "are", "has", "have")
NEGATIVE = ("skepticism", "objection", "correction", "generic_criticism", "privacy_safety_concern")
DEMAND = {
    "explicit_question": 0.78, "request_for_explanation": 0.86, "request_for_tutorial": 0.92, "comparison_request": 0.9, "test_or_proof_request": 0.91, "skepticism": 0.72, "objection": 0.7, "correction": 0.58,
    "missing_use_case": 0.82, "regional_request": 0.8, "pricing_request": 0.88, "privacy_safety_concern": 0.88, "request_for_update": 0.76, "emotional_reaction": 0.12, "generic_praise": 0.05, "generic_criticism": 0.18, "spam_irrelevant": 0.0,
}
# Entities in the order in which a text's are listed, products first.
PRODUCTS = tuple(Rule(name, (name.lower(),)) for name in (
    "NVIDIA", "OpenAI", "Claude Code", "Claude", "ChatGPT", "Grok", "Gemini", "Kimi", "DeepSeek", "Qwen", "Cursor", "Windsurf", "Lovable", "OpenClaw", "Hermes", "Higgsfield", "Sora", "Veo", "Runway", "Kling", "Luma", "Pika",
)) + (Rule("Wan", ("wan 2", "wan2")), Rule("ComfyUI", ("comfyui",)), Rule("Ollama", ("ollama",)))
DOMAINS = (
    Rule("Coding agents", ("coding agent", "multi agent coding", "ai assisted development")),
    Rule("AI agents", ("ai agent", "ai agents", "agentic")),
    Rule("AI video generation", ("ai video", "video generation", "video generator", "text-to-video", "image-to-video")),
    Rule("AI models", ("ai model", "ai models", "model release", "new models")),
    Rule("AI productivity", ("ai productivity", "productivity tool")),
    Rule("AI robotics", ("ai robot", "robotics", "humanoid")),
    Rule("Chinese AI models", ("chinese ai", "china ai", "china's new ai")),
    Rule("Open-source AI", ("open source ai", "open-source ai")),
    Rule("Developer tools", ("coding", "developer", "typescript", "python", "react")),
    Rule("Productivity", ("productivity", "workflow", "work less")),
)
#: Characters of a description in which domains are looked for.
CONTEXT = 800
# Domains that name a microtopic, first ones first; those that say little; facets with their labels.
NAMING = ("AI video generation", "AI robotics", "Chinese AI models", "Developer tools", "Coding agents", "AI agents", "AI models", "AI productivity", "Productivity")
VAGUE = ("AI agents", "AI models", "AI productivity", "Productivity")
FACETS = (
    Rule("free_local", ("free", "unlimited", "no paywall", "on your pc", "100% local", "local ai", "consumer gpu")),
    Rule("beginner_no_code", ("beginner", "first ai", "zero to", "no code", "no-code", "no coding", "without coding", "full course", "in 15 minutes", "in 14 minutes")),
    Rule("applied_workflows", ("recurring task", "for companies", "for teams", "business", "making $", "make money", "day trades", "trading", "real workflow", "worst task")),
    Rule("production_deployment", ("in production", "production workflow", "deployment", "multi-agent", "real project")),
    Rule("open_source", ("open source", "open-source", "self-hosted", "self hosted")),
    Rule("release_wave", ("new model", "new models", "new ai", "release", "is here", "changed everything", "panicking", "breakthrough", "deepseek moment")),
    Rule("comparison", ("compare", "compared", "comparison", " versus ", " vs ", "best ", "the last ")),
    Rule("security_failure", ("rogue", "hacked", "security failure", "unsafe", "jailbreak")),
)
LABELS = {
    "free_local": "Free, local and unlimited", "beginner_no_code": "Beginner and no-code", "applied_workflows": "Task-specific", "production_deployment": "Production and deployment",
    "open_source": "Open-source", "release_wave": "Newly released", "comparison": "Compared", "security_failure": "Security failures in",
}
TOKEN = "[a-z0-9][a-z0-9+#.-]{1,}"
SPACE = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@cache
def _automaton(groups: tuple[tuple[str, ...], ...]):
    import ahocorasick

    owners: dict[str, set[int]] = {}
    for group, phrases in enumerate(groups):
        for phrase in phrases:
            owners.setdefault(phrase, set()).add(group)
    found = ahocorasick.Automaton()
    for phrase, own in owners.items():
        found.add_word(phrase, own)
    found.make_automaton()
    return found


def groups_in(text: Column, groups: list[tuple[str, ...]]) -> Column:
    """The numbers of the groups of which a text holds a phrase, ascending: one pass over the text for all phrases.  Null has none."""
    fixed = tuple(groups)

    @F.pandas_udf("array<int>")
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _automaton(fixed)
        for texts in batches:
            yield pd.Series([sorted(set().union(*(own for _, own in automaton.iter(t)))) if t else [] for t in texts], dtype=object)

    return search(text)


def one_line(text: Column) -> Column:
    """Lower case, with one space for each run of white space and none at the ends; null becomes empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SPACE, " "))


def token_line(text: Column) -> Column:
    """The tokens of a text in lower case, with a space between them; null becomes empty."""
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0)), " ")


def classify(comments: DataFrame, text: str = "text") -> DataFrame:
    """The rows with taxonomy, matched, spam, demand and sentiment of a comment.

    matched: the numbers of all rules in COMMENT_RULES that apply, ascending; the first gives taxonomy.  A null text
    counts as empty, which is short and so spam.  Whole texts are searched; repeated rows each get their answer;
    older columns of these names are replaced.
    """
    groups = [r.phrases for r in COMMENT_RULES] + [REQUESTS, PROMOTION, LIKING]
    request, promotion, liking = range(len(COMMENT_RULES), len(groups))
    held = comments.select("*", one_line(F.col(text)).alias("_line")).withColumn("_groups", groups_in(F.col("_line"), groups))
    line, asked = F.col("_line"), F.contains("_line", F.lit("?")) | F.col("_line").rlike(rf"^(?:{'|'.join(QUESTION_WORDS)})(?![\p{{L}}\p{{N}}_])")
    links = F.regexp_count("_line", F.lit(r"https?://|www\."))
    needs = {"": F.lit(True), "link": links > 0, "question": asked, "request": asked | F.array_contains("_groups", request), "short": F.regexp_count("_line", F.lit(TOKEN)) < 3}
    applies = [needs[r.need] & (F.array_contains("_groups", i) if r.phrases else F.lit(True)) for i, r in enumerate(COMMENT_RULES)]
    held = held.withColumn("matched", F.array_compact(F.array(*[F.when(a, F.lit(i)) for i, a in enumerate(applies)])))
    held = held.withColumn("taxonomy", F.get(F.array(*[F.lit(r.name) for r in COMMENT_RULES]), F.get("matched", F.lit(0))))
    score = 0.02 + F.least(F.lit(0.55), links * 0.28) + F.when(F.array_contains("_groups", promotion), 0.4).otherwise(0.0) + F.when(line.rlike(r"(.)\1{7,}"), 0.25).otherwise(0.0)
    score = F.when(F.col("taxonomy") == "spam_irrelevant", F.greatest(score, F.lit(0.82))).otherwise(score)
    held = held.withColumn("spam", F.round(F.least(F.lit(1.0), score), 4))
    base = F.element_at(F.create_map(*[F.lit(v) for pair in DEMAND.items() for v in pair]), F.col("taxonomy")) + F.when(F.contains("_line", F.lit("?")), 0.05).otherwise(0.0)
    held = held.withColumn("demand", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base * (1 - F.col("spam")))), 4))
    liked = (F.col("taxonomy") == "generic_praise") | F.array_contains("_groups", liking)
    return held.withColumn("sentiment", F.when(F.col("taxonomy").isin(*NEGATIVE), "negative").when(liked, "positive").otherwise("neutral")).drop("_line", "_groups")


@cache
def _entity_groups() -> tuple[tuple[str, ...], ...]:
    return tuple(tuple(" ".join(re.findall(TOKEN, p)) for p in r.phrases) for r in PRODUCTS + DOMAINS)


def with_entities(documents: DataFrame, title: str = "title", description: str = "description", context: int = CONTEXT) -> DataFrame:
    """The rows with products (those of the title) and entities (products, then domains of title or description), in dictionary order.

    Phrases and texts are compared by their tokens, so a phrase may begin or end inside a token.  Of a description the
    first `context` characters count.  Null and empty texts hold nothing.  Older columns of these two names are replaced.
    """
    groups, names = list(_entity_groups()), F.array(*[F.lit(r.name) for r in PRODUCTS + DOMAINS])
    in_title, in_context = groups_in(token_line(F.col(title)), groups), groups_in(token_line(F.substring(description, 1, context)), groups)
    first = F.lit(len(PRODUCTS))
    held = documents.select("*", in_title.alias("_title"), in_context.alias("_context"))
    products, domains = F.filter("_title", lambda g: g < first), F.filter(F.array_sort(F.array_union("_title", "_context")), lambda g: g >= first)
    named = [F.transform(g, lambda i: F.get(names, i)) for g in (products, F.concat(products, domains))]
    return held.select(*[F.col(f"`{c}`") for c in documents.columns if c not in ("products", "entities")], named[0].alias("products"), named[1].alias("entities"))


def microtopic_members(documents: DataFrame, doc_id: str = "doc_id", title: str = "title") -> DataFrame:
    """(doc_id, topic_key, domain, facet, anchor, entities) of the documents that belong to a microtopic, from rows of with_entities.

    A microtopic is a domain, a facet of the title (the first whose phrase it holds) and a product of the title,
    or two for comparisons; without a product the anchor is null, and release waves and comparisons need one.
    The domain is the one the title names, then a telling one, then that of most words, then the first in order.
    """
    lowered = F.lower(F.coalesce(F.col(title), F.lit("")))

    def named(domain: str) -> Column:
        said = F.contains(lowered, F.lit(domain.lower()))
        return said | F.contains(lowered, F.lit(domain.lower()[:-1])) if domain.endswith("s") else said

    options = [
        F.when(F.array_contains("entities", d), F.struct(named(d).alias("named"), F.lit(d not in VAGUE).alias("telling"), F.lit(len(d.split())).alias("words"), F.lit(-i).alias("place"), F.lit(d).alias("domain")))
        for i, d in enumerate(NAMING)
    ]
    facets = F.array(*[F.lit(r.name) for r in FACETS])
    facet = F.get(facets, F.get(groups_in(F.concat(F.lit(" "), lowered, F.lit(" ")), [r.phrases for r in FACETS]), F.lit(0)))
    held = documents.select(F.col(doc_id).alias("doc_id"), "entities", "products", F.array_max(F.array_compact(F.array(*options)))["domain"].alias("domain"), facet.alias("facet"))
    held = held.filter("domain is not null and facet is not null")
    both = F.when((F.col("facet") == "comparison") & (F.size("products") >= 2), F.array_join(F.slice("products", 1, 2), " vs "))
    held = held.withColumn("anchor", F.coalesce(both, F.get("products", F.lit(0)))).filter("anchor is not null or facet not in ('release_wave', 'comparison')")
    print_of = F.concat_ws("|", F.lower("domain"), "facet", F.lower(F.coalesce("anchor", F.lit("generic"))))
    return held.select("doc_id", F.concat(F.lit("micro-"), F.substring(F.sha2(print_of, 256), 1, 18)).alias("topic_key"), "domain", "facet", "anchor", "entities")


def microtopics(members: DataFrame) -> DataFrame:
    """One row a microtopic: topic_key, label, alias, entities, n_documents, specificity, facet.

    entities: domain, anchor, then others of two members or more, most frequent first (ties: the lesser name).  A
    repeated row counts for entities, not for n_documents.  Ids stay in the members' table, so no list grows
    with a topic; counts are taken by topic and entity first, so a hot topic is no hot task.
    """
    topic = ["topic_key", "domain", "facet", "anchor"]
    sizes = members.filter("doc_id is not null").select("topic_key", "doc_id").distinct().groupBy("topic_key").agg(F.count("*").alias("n_documents"))
    counted = members.select(*topic, F.explode_outer("entities").alias("entity")).groupBy(*topic, "entity").agg(F.count("*").alias("n"))
    # At most one row for each dictionary entry and topic.
    others = F.array_sort(F.collect_list(F.when((F.col("n") >= 2) & (F.col("entity") != F.col("domain")) & ~F.equal_null("entity", "anchor"), F.struct((-F.col("n")).alias("n"), "entity"))))["entity"]
    rows = counted.groupBy(*topic).agg(others.alias("others")).join(sizes, "topic_key", "left")
    rows = rows.withColumn("entities", F.concat(F.array("domain"), F.array_compact(F.array("anchor")), "others")).withColumn("n_documents", F.coalesce("n_documents", F.lit(0).cast("bigint")))
    prefix = F.element_at(F.create_map(*[F.lit(v) for pair in LABELS.items() for v in pair]), F.col("facet"))
    alias = F.concat_ws(" ", prefix, "domain")
    label = (
        F.when(F.col("anchor").isNull(), alias)
        .when(F.col("facet") == "release_wave", F.format_string("New %s release", "anchor"))
        .when(F.col("facet") == "comparison", F.format_string("%s comparison", "anchor"))
        .otherwise(F.concat_ws(" ", prefix, "anchor", F.lower("domain")))
    )
    specific = F.least(F.lit(100.0), 56.0 + F.least("n_documents", F.lit(6)) * 4 + F.least(F.size("entities"), F.lit(3)) * 5 + F.when(F.col("anchor").isNotNull(), 12).otherwise(0))
    return rows.select("topic_key", label.alias("label"), alias.alias("alias"), "entities", "n_documents", specific.alias("specificity"), "facet")


#: Terms of a group that are tried before all of them are.
FIRST_TERMS = 1000


def ranked_terms(weights: DataFrame, most: int, group: str = "source", boost: float = 1.15) -> DataFrame:
    """(group, rank, term, weight) of each group's best terms, from rows (group, term, weight).

    A term is passed over if a better chosen one holds all its words and more, or only some of them.  Terms of
    several words weigh `boost` times as much in the order; ties go to the lesser term.  Each of `most` rounds finds
    every group's next term by one grouped minimum, so no task holds a group.  Null groups, terms and weights
    are left out; a repeated term counts once, by its best weight.
    """
    known = weights.select(F.col(group).alias("g"), "term", F.col("weight").cast("double").alias("weight")).dropna()
    best = known.groupBy("g", "term").agg(F.max("weight").alias("weight"))
    words = F.array_distinct(F.split("term", " "))
    held = written(best.withColumns({"by": -F.col("weight") * F.when(F.contains("term", F.lit(" ")), boost).otherwise(1.0), "words": words}), "terms")

    def parted(c: Column) -> Column:
        mine, theirs = F.size(F.array_except("words", c)), F.size(F.array_except(c, F.col("words")))
        return (mine == 0) != (theirs == 0)

    none = "cast(array() as array<struct<by:double,term:string,weight:double,words:array<string>>>) AS chosen"
    state = written(held.select("g").distinct().selectExpr("g", none), "chosen")
    # A term depends on better ones only: what a group's first terms fill is final.  Groups that they do not fill go through all their terms.
    best_first = Window.partitionBy("g").orderBy("by", "term")
    early = written(held.withColumn("at", F.row_number().over(best_first)).filter(F.col("at") <= FIRST_TERMS).drop("at"), "early")
    for terms in (early, held):
        for _ in range(most):
            short = state.filter(F.size("chosen") < most)
            if terms is held and short.isEmpty():
                break
            open_ = terms.join(bounded(short), "g").filter(~F.exists("chosen", lambda c: (c["term"] == F.col("term")) | parted(c["words"])))
            nearest = open_.groupBy("g").agg(F.min(F.struct("by", "term", "weight", "words")).alias("next"))
            grown = F.when(F.col("next").isNotNull(), F.concat("chosen", F.array("next"))).otherwise(F.col("chosen"))
            state = written(state.join(nearest, "g", "left").select("g", grown.alias("chosen")), "chosen")
    return state.select(F.col("g").alias(group), F.posexplode("chosen").alias("at", "t")).select(group, (F.col("at") + 1).alias("rank"), "t.term", "t.weight")


#: How the tables stand for comments and titles: invented prose holds few phrases, so each row's ids choose some that are put before its own text.
PUT_IN = tuple(p for r in COMMENT_RULES for p in r.phrases) + REQUESTS + ("", "how", "https://a.example telegram", "zzzzzzzzz", "great?")
TITLES = (tuple(p for r in PRODUCTS for p in r.phrases) + ("",), tuple(p for r in DOMAINS for p in r.phrases), tuple(p for r in FACETS for p in r.phrases) + ("",))


def _comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    at = (F.col("conv_id") * 31 + F.col("turn") * 7) % len(PUT_IN)
    asks = F.when(F.col("conv_id") % 2 == 0, " please ").otherwise(" ")
    return rows.select("conv_id", "turn", F.concat(F.get(F.array(*map(F.lit, PUT_IN)), at.cast("int")), asks, F.coalesce("text", F.lit(""))).alias("text"))


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chosen = [F.get(F.array(*map(F.lit, phrases)), ((F.col("doc_id") * step + F.length("lang")) % len(phrases)).cast("int")) for phrases, step in zip(TITLES, (5, 3, 1))]
    chosen = [F.coalesce(c, F.lit("")) for c in chosen]
    return rows.select("doc_id", F.concat_ws(" ", chosen[0], "source", chosen[1], chosen[2]).alias("title"), F.col("text").alias("description"))


def _any(text: str, phrases: tuple[str, ...]) -> str:
    """DuckDB: the text holds one of the phrases, as one pattern."""
    pattern = "|".join(re.escape(p) for p in phrases).replace("'", "''")
    return f"regexp_matches({text}, '{pattern}')"


def _list(phrases: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in phrases) + "]"


def _comment_sql() -> str:
    needs = {"": "true", "link": "links > 0", "question": "asked", "request": f"(asked OR {_any('t', REQUESTS)})", "short": f"len(regexp_extract_all(t, '{TOKEN}')) < 3"}
    rules = ", ".join(f"CASE WHEN {needs[r.need]} AND {_any('t', r.phrases) if r.phrases else 'true'} THEN {i} END" for i, r in enumerate(COMMENT_RULES))
    names, base = _list(tuple(r.name for r in COMMENT_RULES)), " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in DEMAND.items())
    return f"""WITH c AS (SELECT conv_id, turn, ({_list(PUT_IN)})[1 + (conv_id * 31 + turn * 7) % {len(PUT_IN)}] || CASE WHEN conv_id % 2 = 0 THEN ' please ' ELSE ' ' END || coalesce(text, '') AS x FROM conversations),
l AS (SELECT conv_id, turn, trim(regexp_replace(lower(x), '{SPACE}', ' ', 'g')) AS t FROM c),
f AS (SELECT *, contains(t, '?') OR regexp_matches(t, '^({"|".join(QUESTION_WORDS)})([^\\p{{L}}\\p{{N}}_]|$)') AS asked, len(regexp_extract_all(t, 'https?://|www\\.')) AS links FROM l),
m AS (SELECT *, list_filter([{rules}], lambda x: x IS NOT NULL) AS matched FROM f),
n AS (SELECT *, ({names})[1 + matched[1]] AS taxonomy, .02e0 + least(.55e0, links * .28e0) + CASE WHEN {_any("t", PROMOTION)} THEN .4e0 ELSE 0e0 END
    + CASE WHEN len(list_filter(range(1, length(t) - 6), lambda i: substr(t, i, 8) = repeat(substr(t, i, 1), 8))) > 0 THEN .25e0 ELSE 0e0 END AS s FROM m),
o AS (SELECT *, round(least(1e0, CASE WHEN taxonomy = 'spam_irrelevant' THEN greatest(s, .82e0) ELSE s END), 4) AS spam FROM n)
SELECT conv_id, turn, taxonomy, array_to_string(matched, ',') AS matched, spam, round(greatest(0e0, least(1e0, (CASE taxonomy {base} END + CASE WHEN contains(t, '?') THEN .05e0 ELSE 0e0 END) * (1 - spam))), 4) AS demand,
    CASE WHEN list_contains({_list(NEGATIVE)}, taxonomy) THEN 'negative' WHEN taxonomy = 'generic_praise' OR {_any("t", LIKING)} THEN 'positive' ELSE 'neutral' END AS sentiment FROM o"""


def _entity_ctes() -> str:
    picks = [f"coalesce(({_list(p)})[1 + (doc_id * {step} + coalesce(length(lang), 0)) % {len(p)}], '')" for p, step in zip(TITLES, (5, 3, 1))]
    phrases = _entity_groups()
    own = ", ".join(f"CASE WHEN {_any('tt', p)} THEN '{r.name}' END" for r, p in zip(PRODUCTS, phrases))
    domains = ", ".join(f"CASE WHEN {_any('tt', p)} OR {_any('dt', p)} THEN '{r.name}' END" for r, p in zip(DOMAINS, phrases[len(PRODUCTS) :]))
    return f"""WITH v AS (SELECT doc_id, concat_ws(' ', {picks[0]}, source, {picks[1]}, {picks[2]}) AS title, coalesce(text, '') AS description FROM documents),
w AS (SELECT *, array_to_string(regexp_extract_all(lower(title), '{TOKEN}'), ' ') AS tt, array_to_string(regexp_extract_all(lower(left(description, {CONTEXT})), '{TOKEN}'), ' ') AS dt FROM v),
e AS (SELECT doc_id, title, list_filter([{own}], lambda x: x IS NOT NULL) AS products, list_filter([{domains}], lambda x: x IS NOT NULL) AS domains FROM w),
en AS (SELECT doc_id, title, products, list_concat(products, domains) AS entities FROM e)"""


def _microtopic_sql() -> str:
    naming = ", ".join(f"('{d}', '{d.lower()}', '{d.lower().removesuffix('s')}', {int(d not in VAGUE)}, {len(d.split())}, {i})" for i, d in enumerate(NAMING))
    facets = " ".join(f"WHEN {_any('padded', r.phrases)} THEN '{r.name}'" for r in FACETS)
    prefixes = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LABELS.items())
    return f"""{_entity_ctes()}, nm AS (SELECT * FROM (VALUES {naming}) AS x(domain, long, short, telling, words, place)),
x AS (SELECT en.*, ' ' || lower(title) || ' ' AS padded, row_number() OVER () AS r FROM en),
dm AS (SELECT r, arg_max(domain, (contains(padded, long) OR contains(padded, short))::int * 10000 + telling * 1000 + words * 100 - place) AS domain FROM x JOIN nm ON list_contains(entities, domain) GROUP BY r),
fa AS (SELECT doc_id, entities, domain, CASE {facets} END AS facet, products FROM x JOIN dm USING (r)),
an AS (SELECT *, CASE WHEN facet = 'comparison' AND len(products) >= 2 THEN products[1] || ' vs ' || products[2] ELSE products[1] END AS anchor FROM fa WHERE facet IS NOT NULL),
me AS (SELECT *, 'micro-' || substr(sha256(lower(domain) || '|' || facet || '|' || lower(coalesce(anchor, 'generic'))), 1, 18) AS topic_key FROM an WHERE anchor IS NOT NULL OR facet NOT IN ('release_wave', 'comparison')),
cl AS (SELECT topic_key, any_value(domain) AS domain, any_value(facet) AS facet, any_value(anchor) AS anchor, count(DISTINCT doc_id) AS n_documents FROM me GROUP BY 1),
oc AS (SELECT topic_key, entity, count(*) AS n FROM (SELECT topic_key, unnest(entities) AS entity FROM me) GROUP BY 1, 2),
ot AS (SELECT topic_key, list(entity ORDER BY n DESC, entity) AS others FROM oc JOIN cl USING (topic_key) WHERE n >= 2 AND entity <> domain AND entity IS DISTINCT FROM anchor GROUP BY 1),
al AS (SELECT *, CASE facet {prefixes} END AS prefix, list_concat(CASE WHEN anchor IS NULL THEN [domain] ELSE [domain, anchor] END, coalesce(others, [])) AS entities FROM cl LEFT JOIN ot USING (topic_key))
SELECT topic_key, CASE WHEN anchor IS NULL THEN prefix || ' ' || domain WHEN facet = 'release_wave' THEN 'New ' || anchor || ' release' WHEN facet = 'comparison' THEN anchor || ' comparison' ELSE prefix || ' ' || anchor || ' ' || lower(domain) END AS label,
    prefix || ' ' || domain AS alias, array_to_string(entities, '|') AS entities, n_documents, least(100e0, 56 + least(n_documents, 6) * 4 + least(len(entities), 3) * 5 + CASE WHEN anchor IS NULL THEN 0 ELSE 12 END) AS specificity, facet FROM al"""


@query(_comment_sql())
def comment_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory rows I11, I12: turns of conversations stand for comments, each with a phrase that its ids choose."""
    return classify(_comments(spark, sf_dir)).select("conv_id", "turn", "taxonomy", F.array_join("matched", ",").alias("matched"), "spam", "demand", "sentiment")


@query(_entity_ctes() + " SELECT doc_id, array_to_string(products, '|') AS products, array_to_string(entities, '|') AS entities FROM en")
def entity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory row I14: documents stand for videos, with titles that their ids choose."""
    return with_entities(_titled(spark, sf_dir)).select("doc_id", F.array_join("products", "|").alias("products"), F.array_join("entities", "|").alias("entities"))


@query(_microtopic_sql())
def microtopic_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory row I15, the first of its identity rules: the same titles, grouped by domain, facet and anchor."""
    members = written(microtopic_members(with_entities(_titled(spark, sf_dir))), "members")
    return microtopics(members).withColumn("entities", F.array_join("entities", "|"))


_TERMS_SQL = """WITH RECURSIVE t AS (SELECT source, regexp_extract_all(lower(text), '[a-zà-ÿ0-9]+') AS a FROM documents WHERE source IS NOT NULL),
o AS (SELECT source, unnest(a) AS term, 2.5e0 AS w FROM t UNION ALL SELECT source, p[1] || ' ' || p[2], 2.2e0 FROM (SELECT source, unnest(list_zip(a[:-2], a[2:])) AS p FROM t) WHERE p[1] <> p[2]),
s AS (SELECT source, term, count(*) * any_value(w) AS weight, list_distinct(string_split(term, ' ')) AS ws FROM o GROUP BY 1, 2),
r AS (SELECT source, 0 AS rank, cast(NULL AS varchar) AS term, 0e0 AS weight, cast([] AS varchar[]) AS chosen FROM (SELECT DISTINCT source FROM s)
    UNION ALL SELECT source, k, b.term, b.weight, list_append(chosen, b.term) FROM (SELECT s.source, rank + 1 AS k, chosen, min_by({'term': s.term, 'weight': s.weight}, (-s.weight * CASE WHEN contains(s.term, ' ') THEN 1.15e0 ELSE 1e0 END, s.term)) AS b
    FROM s JOIN r USING (source) WHERE rank < 8 AND NOT list_contains(chosen, s.term)
    AND len(list_filter(chosen, lambda c: list_has_all(ws, string_split(c, ' ')) <> list_has_all(string_split(c, ' '), ws))) = 0 GROUP BY s.source, rank, chosen))
SELECT source, rank, term, round(weight, 4) AS weight FROM r WHERE rank > 0"""


@query(_TERMS_SQL)
def greedy_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory row F7: the eight best tokens and pairs of neighbouring tokens of each source."""
    tokens = F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ0-9]+"), F.lit(0))
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("source", tokens.alias("a"))
    pairs = F.zip_with("a", F.slice("a", 2, F.greatest(F.size("a") - 1, F.lit(0))), lambda x, y: F.when(x != y, F.concat(x, F.lit(" "), y)))
    counts = texts.select("source", F.explode(F.array_compact(F.concat("a", pairs))).alias("term")).groupBy("source", "term").agg(F.count("*").alias("n"))
    found = ranked_terms(counts.select("source", "term", (F.col("n") * F.when(F.contains("term", F.lit(" ")), 2.2).otherwise(2.5)).alias("weight")), 8)
    return found.select("source", "rank", "term", F.round("weight", 4).alias("weight"))

"""From hits to an answer: relevance, and passages of the leading document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import text as T

# Words that ask for a number, and patterns.
NUMERIC_INTENT = ("금액", "얼마", "합계", "총액", "수량", "비율", "날짜", "기한")
VALUE = r"\d|[일이삼사오육칠팔구십백천만억]+(?:명|년|개월|주|일|시간|점|원|퍼센트)"
IDENTIFIER = r"(?i)\b(?=[A-Z0-9._/-]*[A-Z])(?=[A-Z0-9._/-]*\d)[A-Z0-9]+(?:[-_/][A-Z0-9.]+)+\b"
APPROVAL = r"승인(?:되었|됐|하였다|했다|한다|함|완료|결정)"
DECISION_PREFIXES = ("승인", "변경")
GENERIC_TERMS = ("승인", "기준", "상태", "조건", "절차", "규정", "내용")
ASKING_TERMS = ("되어", "되는지", "있는지", "있는가")
ASKING_ENDINGS = ("인가", "있는가", "되는가", "나요", "습니까")


def squashed(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def has_identifiers(query: Column, text: Column) -> Column:
    """All code-like identifiers of the query occur in the text, letters and digits alone compared."""
    hay = squashed(text)
    return F.forall(T.matches(query, IDENTIFIER), lambda i: F.contains(hay, squashed(i)))


def has_value(query: Column, body: Column) -> Column:
    asks = F.exists(F.array(*map(F.lit, NUMERIC_INTENT)), lambda w: F.contains(query, w))
    return ~asks | body.rlike(VALUE)


def has_approval(body: Column) -> Column:
    return body.rlike(APPROVAL)


def asks_value(query: Column) -> Column:
    return F.exists(F.array(*map(F.lit, NUMERIC_INTENT)), lambda w: F.contains(query, w))


def focus_terms(query: Column) -> Column:
    """What a question is about: keywords behind its last genitive particle, without general and asking words."""
    behind = F.when(F.contains(query, F.lit("의")), F.element_at(F.split(query, "의"), -1)).otherwise(F.lit(""))
    own = F.array_except(T.keywords(behind), F.array(*map(F.lit, GENERIC_TERMS + ASKING_TERMS)))
    return F.filter(own, lambda t: ~t.rlike("(" + "|".join(ASKING_ENDINGS) + ")$"))


def adequacy(hits: DataFrame, lexical: bool = True) -> DataFrame:
    """query_id, refusal (null: answerable), n_evidence of hits (query_id, query, unit_id, title, body, locator_type, partial, document_id,
    asserted, stale): the first reason that holds, after gates each of which sees what the one before has left.

    Relevance (what an assertion cites is relevant), whole workbooks and tables for numbers, identifiers, focus, values; several
    documents for a question too short to tell them apart; decisions without a word of approval; nothing fresh, nothing at all.
    """
    q, low = F.col("query"), F.lower(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.col("body")))
    keys = T.keywords("query")
    numeric, decision = asks_value(q), F.contains(q, F.lit("승인")) & F.lit(lexical)
    subject = F.filter(keys, lambda k: ~k.rlike("^(" + "|".join(DECISION_PREFIXES) + ")"))
    relevant = F.coalesce("asserted", F.lit(False)) | T.relevant("query", "body") if lexical else F.lit(True)
    focused = F.forall(focus_terms(q), lambda t: F.contains(low, t))
    plain = F.size(F.array_except(keys, F.array(*map(F.lit, GENERIC_TERMS)))) == 0
    short = (F.size(T.matches(q, IDENTIFIER)) == 0) & (F.size(keys) <= 2)
    j = hits.select(
        "query_id",
        "document_id",
        "stale",
        relevant.alias("s1"),
        has_identifiers(q, low).alias("i"),
        focused.alias("f"),
        (~numeric | F.col("body").rlike(VALUE)).alias("v"),
        ((F.col("locator_type") == "xlsx_sheet") & numeric).alias("x"),
        ((F.col("locator_type") == "csv_rows") & F.coalesce("partial", F.lit(False)) & numeric).alias("c"),
        decision.alias("decision"),
        (plain | short).alias("vague"),
        F.size(F.filter(subject, lambda k: F.contains(F.lower("body"), k))).alias("score"),
        has_approval(F.col("body")).alias("approves"),
    )
    j = j.withColumn("s2", F.col("s1") & F.col("i")).withColumn("s3", F.col("s2") & F.col("f")).withColumn("s4", F.col("s3") & F.col("v"))
    # a decision rests on the pieces of evidence that name most of its subject
    best = F.max(F.when(F.col("s4"), F.col("score"))).over(Window.partitionBy("query_id"))
    j = j.withColumn("last", F.col("s4") & (~F.col("decision") | (F.col("score") == best)))
    g = j.groupBy("query_id").agg(
        *[F.count_if(s).alias(f"n{s}") for s in ("s1", "s2", "s3", "s4", "last")],
        F.bool_or(F.col("s1") & F.col("x")).alias("x"),
        F.bool_or(F.col("s1") & F.col("c")).alias("c"),
        F.countDistinct(F.when(F.col("s4"), F.col("document_id"))).alias("documents"),
        F.bool_or("vague").alias("vague"),
        F.bool_or("decision").alias("decision"),
        F.bool_or(F.col("last") & F.col("approves")).alias("approves"),
        F.bool_or(F.coalesce("stale", F.lit(False))).alias("stale"),
    )
    absent = ((F.col("ns1") > 0) & (F.col("ns4") == 0)).alias("absent")
    refusal = (
        F.when(F.col("x"), "exact_xlsx_read_required")
        .when(F.col("c"), "csv_full_table_required")
        .when(absent, "answer_not_present")
        .when((F.col("documents") > 1) & F.col("vague"), "clarification_required")
        .when(F.col("decision") & (F.col("nlast") > 0) & ~F.col("approves"), "insufficient_decision_evidence")
        .when(F.col("nlast") == 0, F.when(F.col("stale"), "no_fresh_evidence").otherwise("no_admissible_evidence"))
    )
    return g.select("query_id", refusal.alias("refusal"), F.when(refusal.isNull(), F.col("nlast")).otherwise(0).alias("n_evidence"))


def extractive(hits: DataFrame, max_chars: int) -> DataFrame:
    """query_id, unit_id, passage: texts of the leading hit's document (query_id, unit_id, document_id, rank, body) until max_chars."""
    lead = hits.groupBy("query_id").agg(F.min_by("document_id", "rank").alias("document_id"))
    own = hits.join(lead, ["query_id", "document_id"])
    before = F.coalesce(F.sum(F.length("body")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = own.withColumn("room", F.lit(max_chars) - before).where("room > 0")
    return room.select("query_id", "unit_id", "document_id", "rank", F.substring("body", F.lit(1), F.col("room").cast("int")).alias("passage"))


def unsupported(claims: DataFrame, known: DataFrame, allowed: DataFrame) -> DataFrame:
    """claim ids (claim_id, evidence_ids) that cite nothing, or cite evidence that isn't known or mustn't leave."""
    each = claims.select("claim_id", F.explode_outer("evidence_ids").alias("evidence_id"))
    good = known.select("evidence_id").join(allowed.select("evidence_id"), "evidence_id", "left_semi")
    return each.join(good, "evidence_id", "left_anti").select("claim_id").distinct()

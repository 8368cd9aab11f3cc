"""Grounding audit: each statement of an answer against the pieces of evidence that it cites itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.text import fold
from lodestar.operators.numbers import NUMBER, verdicts
from lodestar.plans.registry import query
from lodestar.sources.bindings import CHUNKS, FOLD, chunks

# Grades that may not be cited, the grade that must be called indirect, and how it is called.
REFUSED, INDIRECT, CALLED_INDIRECT = ["C", "D"], "B", r"\b(indirect|indirecte|indirectly|indirectement|suggests?|suggere)"
#: Wording that the cited text must have itself: code, what makes a statement such, what makes a text such (folded, English and French).
RULES = [
    ("norm", r"\b(must|should|recommended|doit|doivent|il faut|recommande)\b", r"\b(must|should|recommend\w*|require\w*|doit|doivent|recommand\w*)\b"),
    ("safety", r"\b(safe|unsafe|toxic|harmless|dangerous|sans danger|toxique)\b", r"\b(safe\w*|unsafe|toxic\w*|harm\w*|danger\w*|toxique)\b"),
    ("cause", r"\b(causes?|caused by|leads? to|because of|entraine|provoque)\b", r"\b(cause\w*|lead\w* to|result\w* in|due to|entraine\w*|provoque\w*)\b"),
    ("superlative", r"\b(best|worst|most effective|optimal|le meilleur|optimale?)\b", r"\b(best|worst|most|optim\w*|meilleur\w*)\b"),
    ("certainty", r"\b(proves?|proven|always|never|certainly|prouve|toujours|jamais)\b", r"\b(prove\w*|always|never|certain\w*|prouve\w*|toujours|jamais)\b"),
]
#: All codes in the order in which they are looked for; a statement's code is the first that holds.
CODES = ["no_evidence", "outside", "fragment", "leaked_id", "refused_grade", "not_called_indirect", *(code for code, *_ in RULES), "number", "grounded"]


def audited(statements: DataFrame, evidence: DataFrame, allowed: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``answer_id, statement_id, code, codes`` of every row of ``statements(answer_id, statement_id, text, cited)``.

    ``evidence(evidence_id, text, grade)`` are the pieces, ``allowed(answer_id, evidence_id)`` those that an answer was given. In order: nothing cited; a piece cited that was not given; a heading
    or list mark in place of a statement; the id of a piece in the text; a piece of a refused grade; one of the indirect grade without
    saying so; wording of a rule that no cited piece has; quantities that no cited piece states. Numbers are excused if the statement has no quantity but bare numbers, and all of them stand in a cited piece.
    Cited lists are exploded and joined; only one statement's own pieces meet it.
    """
    key = ["answer_id", "statement_id"]
    cited = statements.select(*key, F.explode(F.array_distinct("cited")).alias("evidence_id"))
    given = allowed.select("answer_id", "evidence_id").distinct().withColumn("given", F.lit(True))
    met = cited.join(given, ["answer_id", "evidence_id"], "left").join(evidence.withColumnRenamed("text", "said"), "evidence_id", "left")
    bare = lambda c: F.transform(F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(NUMBER), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit(".")))
    own = met.groupBy(*key).agg(
        F.max(F.coalesce(~F.col("given"), F.lit(True)) | F.col("said").isNull()).alias("outside"), F.array_join(F.collect_list(fold(F.col("said"))), " ").alias("said"),
        F.max(F.col("grade").isin(REFUSED)).alias("refused"), F.max(F.col("grade") == INDIRECT).alias("indirect"), F.array_distinct(F.flatten(F.collect_list(bare("said")))).alias("numbers"), F.collect_set("evidence_id").alias("ids"),
    )
    name = F.to_json(F.struct(*key))
    checked = verdicts(statements.select(name.alias("claim_id"), "text"), met.where("said IS NOT NULL").select(name.alias("claim_id"), "evidence_id", F.col("said").alias("text")))
    rows = statements.withColumn("claim_id", name).join(own, key, "left").join(checked.select("claim_id", "verdict"), "claim_id", "left")
    text, folded, said = F.trim("text"), fold(F.col("text")), F.coalesce("said", F.lit(""))
    excused = (F.size(F.array_except(bare("text"), F.coalesce("numbers", F.array().cast("array<string>")))) == 0) & ~F.col("text").rlike(rf"{NUMBER}\s*(%|[a-zA-Zµ°]+/[a-zA-Z]|[mµkn]?g\b|[mh]?[lL]\b|°C)")
    holds = {
        "no_evidence": F.size("cited") <= 0, "outside": F.coalesce("outside", F.lit(False)), "fragment": text.rlike(r"^[-*•]|:$") | (text == ""), "leaked_id": F.exists(F.coalesce("ids", F.array().cast("array<string>")), lambda x: F.contains(F.col("text"), x.cast("string"))),
        "refused_grade": F.coalesce("refused", F.lit(False)), "not_called_indirect": F.coalesce("indirect", F.lit(False)) & ~folded.rlike(CALLED_INDIRECT),
        **{code: folded.rlike(claim) & ~said.rlike(source) for code, claim, source in rules}, "number": (F.col("verdict") == "unsupported") & ~excused,
    }
    codes = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), code) for code, c in holds.items())))
    return rows.select(*key, F.coalesce(F.get(codes, F.lit(0)), F.lit("grounded")).alias("code"), codes.alias("codes"))


def stored_statements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every stored chunk is evidence, graded by its place, and the statement of the chunk's article that cites it; some cite another article's chunk, some a piece that there is not."""
    i = F.col("chunk_id")
    own = chunks(spark, sf_dir)
    text = F.concat(F.when(i % 7 == 0, F.lit("- ")).otherwise(F.lit("")), F.when(i % 5 == 0, F.lit("it is proven: ")).otherwise(F.lit("")), F.when(i % 11 == 0, F.lit("indirectly, ")).otherwise(F.lit("")), F.col("text"), F.when(i % 13 == 0, F.lit(" 98765,4 mg/L")).otherwise(F.lit("")))
    cited = F.when(i % 17 == 0, F.array().cast("array<long>")).when(i % 19 == 0, F.array(i, -i)).otherwise(F.array(i))
    grade = F.element_at(F.array(*map(F.lit, "ABCDA")), (F.col("chunk_index") % 5 + 1).cast("int"))
    statements = own.select(F.col("article_id").alias("answer_id"), i.alias("statement_id"), text.alias("text"), cited.alias("cited"))
    return statements, own.select(i.alias("evidence_id"), "text", grade.alias("grade")), own.select(F.col("article_id").alias("answer_id"), i.alias("evidence_id"))


def rule_sql(said: str, source: str) -> str:
    return ", ".join(f"CASE WHEN regexp_matches({said}, '{claim}') AND NOT regexp_matches({source}, '{proof}') THEN '{code}' END" for code, claim, proof in RULES)


AUDIT = f"""WITH {CHUNKS}, q AS (SELECT *, (CASE WHEN chunk_id % 7 = 0 THEN '- ' ELSE '' END) || (CASE WHEN chunk_id % 5 = 0 THEN 'it is proven: ' ELSE '' END) || (CASE WHEN chunk_id % 11 = 0 THEN 'indirectly, ' ELSE '' END) || text || (CASE WHEN chunk_id % 13 = 0 THEN ' 98765,4 mg/L' ELSE '' END) AS said,
 (['A','B','C','D','A'])[CAST(chunk_index % 5 + 1 AS INTEGER)] AS grade, chunk_id % 17 <> 0 AS cites FROM chunks), f AS (SELECT *, {FOLD.format(x='said')} AS s, CASE WHEN cites THEN {FOLD.format(x='text')} ELSE '' END AS t FROM q)
SELECT article_id AS answer_id, chunk_id AS statement_id, coalesce(list_filter([CASE WHEN NOT cites THEN 'no_evidence' END, CASE WHEN cites AND chunk_id % 19 = 0 THEN 'outside' END, CASE WHEN regexp_matches(trim(said, ' '), '^[-*•]|:$') THEN 'fragment' END, CASE WHEN cites AND contains(said, CAST(chunk_id AS VARCHAR)) THEN 'leaked_id' END,
 CASE WHEN cites AND grade IN ('C', 'D') THEN 'refused_grade' END, CASE WHEN cites AND grade = 'B' AND NOT regexp_matches(s, '{CALLED_INDIRECT}') THEN 'not_called_indirect' END, {rule_sql('s', 't')}, CASE WHEN chunk_id % 13 = 0 THEN 'number' END], lambda x: x IS NOT NULL)[1], 'grounded') AS code FROM f"""


@query("grounding_audit", AUDIT)
def grounding_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of each stored statement."""
    return audited(*stored_statements(spark, sf_dir)).select("answer_id", "statement_id", "code")

"""A verifier's answers: parsing, backfill of paragraphs it lost, and the audit report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import align, terms

# The answer's headings.
VERIFIED = r"###\s*VERIFIED\s+TRANSLATION:\s*"
NOTES = r"^###\s*AUDIT\s+NOTES:\s*"
NO_NOTES = "No structured audit header detected."


def backfill(draft: Column | str, verified: Column | str) -> Column:
    """verified, or, where it lacks tags of the draft, all its tags with the draft's for those."""

    def build(both: Column) -> Column:
        own, old = both["v"], both["d"]
        lost = F.filter(old, lambda t: ~F.exists(own, lambda v: v["idx"] == t["idx"]))
        every = F.array_sort(F.concat(own, lost))
        return F.when(F.size(lost) == 0, T.text_of(verified)).otherwise(F.array_join(F.transform(every, lambda t: F.concat(F.lit("[P"), t["idx"].cast("string"), F.lit("]\n"), t["content"])), "\n\n"))

    return align.once(F.struct(align.tags(draft).alias("d"), align.tags(verified).alias("v")), build)


def parse(response: Column | str, fallback: Column | str | None = None) -> Column:
    """struct<audit_notes, verified, novel_terms: array<struct<arabic, target>>>."""
    text, draft = T.text_of(response), F.lit("") if fallback is None else T.text_of(fallback)
    headed = text.rlike(f"(?iU){VERIFIED}")
    parts = F.split(text, f"(?iU){VERIFIED}", 2)
    before, after = T.strip(F.get(parts, F.lit(0))), T.strip(F.get(parts, F.lit(1)))
    whole = F.when(draft != "", draft).otherwise(T.strip(text))
    verified = F.when(headed & (after != ""), after).otherwise(whole)
    sections = F.split(before, f"(?iU){terms.NEW_TERMS}", 2)
    notes = F.when(headed, T.strip(F.regexp_replace(F.get(sections, F.lit(0)), f"(?iU){NOTES}", ""))).otherwise(NO_NOTES)
    new = F.when(headed & (F.size(sections) == 2), terms.pair_lines(T.strip(F.get(sections, F.lit(1))), True)).otherwise(F.array().cast("array<struct<arabic:string,target:string>>"))
    verified = F.when(draft == "", verified).otherwise(backfill(draft, verified))
    return F.struct(notes.alias("audit_notes"), verified.alias("verified"), new.alias("novel_terms"))


def verified_chunks(rows: DataFrame, response: str = "response", draft: str = "draft") -> DataFrame:
    """rows with audit_notes, verified, novel_terms and has_corrections (the text differs from the draft's)."""
    out = rows.withColumn("__p", parse(response, draft)).select(*rows.columns, "__p.*")
    return out.withColumn("has_corrections", F.col("verified") != T.text_of(draft))


def audit_report(entries: DataFrame, lang: str, domain: str, model: str, provider: str, verifier: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by, total, corrected, report. entries: by, chunk_index (from 1), total_chunks, has_corrections, audit_notes, novel_terms (array of arabic, target)."""
    name = T.LANGUAGES.get(lang.lower().strip(), lang.capitalize())
    new = F.when(F.size(F.coalesce("novel_terms", F.array().cast("array<struct<arabic:string,target:string>>"))) > 0, F.concat(F.lit("\n### New terms\n"), F.array_join(F.transform("novel_terms", lambda t: F.concat(F.lit("- **"), t["arabic"], F.lit("**: "), t["target"])), "\n"), F.lit("\n"))).otherwise("")
    state = F.when(F.col("has_corrections"), "corrected").otherwise("clean")
    part = F.concat(F.format_string("## Chunk %d of %d: ", "chunk_index", "total_chunks"), state, F.lit("\n\n### Notes\n"), T.strip("audit_notes"), F.lit("\n"), new, F.lit("\n---\n"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", part.alias("text")))), lambda p: p["text"]), "\n")
    rows = entries.groupBy(*by).agg(F.count("*").alias("total"), F.count_if("has_corrections").alias("corrected"), parts.alias("parts"))
    head = F.concat(F.lit(f"# Verification report\n\n- **Target language**: {name} (`{lang}`)\n- **Domain**: {domain.upper()}\n- **Translation model**: `{model}` ({provider})\n- **Verifier model**: `{verifier}`\n- **Chunks audited**: "), F.col("total").cast("string"), F.lit("\n- **Chunks with corrections**: "), F.col("corrected").cast("string"), F.lit(" / "), F.col("total").cast("string"), F.lit("\n\n---\n\n"))
    return rows.select(*by, "total", "corrected", F.concat(head, F.col("parts")).alias("report"))


def corrected(entries: DataFrame) -> DataFrame:
    """The review panel: corrected chunks with the first three new terms."""
    return entries.where("has_corrections").withColumn("terms_preview", F.slice("novel_terms", 1, 3))

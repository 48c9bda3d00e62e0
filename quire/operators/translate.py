"""The per-chunk provider stage. The default provider is a deterministic dry run, as expressions; real ones are a callable that is asked in waves, one chunk of each document at a time, since a chunk's prompt holds what the chunk before gave."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import align, terms, verify
from quire.operators.chunking import ARABIC, Profile, chunk_documents
from quire.sources import store

# Subjects by domain, for prompts.
DOMAINS = ("mantiq", "fiqh", "aqida", "akhlaaq", "tadabbur", "thaqafa", "tarikh", "general")
SUBJECTS = {
    "mantiq": "classical logic and philosophical ontology",
    "fiqh": "jurisprudence and legal theory",
    "aqida": "theology and doctrine",
    "akhlaaq": "ethics and moral psychology",
    "tadabbur": "reflection on and exegesis of scripture",
    "thaqafa": "contemporary thought and culture",
    "tarikh": "history and biography",
    "general": "formal scholarship",
}
MODELS = {"gemini": "gemini-model", "openai": "openai-model", "anthropic": "anthropic-model"}


@dataclass(frozen=True)
class Config:
    """Settings of a run; models default to the provider's."""

    provider: str = "dry-run"
    target_lang: str = "en"
    domain: str = "mantiq"
    model: str = ""
    verifier_model: str = ""
    verifier_provider: str = ""
    temperature: float = 0.2
    max_output_tokens: int = 8192
    chunk_size: int = 1500
    overlap: int = 200
    chunk_delay: float = 4.0
    verify: bool = False
    bilingual: bool = False
    strip_vowels: bool = True
    keep_shaddah: bool = False

    @property
    def resolved_model(self) -> str:
        return self.model or MODELS.get(self.provider, self.provider)

    @property
    def resolved_verifier_provider(self) -> str:
        return self.verifier_provider or self.provider

    @property
    def resolved_verifier_model(self) -> str:
        return self.verifier_model or (self.resolved_model if self.resolved_verifier_provider == self.provider else MODELS.get(self.resolved_verifier_provider, self.resolved_verifier_provider))

    @property
    def language(self) -> str:
        return T.LANGUAGES.get(self.target_lang.lower().strip(), self.target_lang.capitalize())


def system_prompt(cfg: Config, glossary: str = "") -> str:
    """Instructions for the translator, in our words; glossary: prompt_glossary()'s block."""
    subject = SUBJECTS.get(cfg.domain.lower().strip(), SUBJECTS["general"])
    lines = [f"Translate classical Arabic texts on {subject} into formal {cfg.language}.", "Translate everything, keep the argument's order, and give technical terms one rendering throughout.", "Give only the translation."]
    if cfg.bilingual:
        lines.append("Each paragraph begins with a tag such as [P1]. Repeat every tag before its translation.")
    return "\n".join(lines) + (f"\n\nUse these renderings:\n{glossary}" if glossary.strip() else "")


def verifier_prompt(cfg: Config) -> str:
    subject = SUBJECTS.get(cfg.domain.lower().strip(), SUBJECTS["general"])
    tags = " Keep every tag such as [P1]." if cfg.bilingual else ""
    return f"Compare a draft {cfg.language} translation of an Arabic text on {subject} with its source and correct what deviates.{tags}\nAnswer with three sections:\n### AUDIT NOTES:\n### NOVEL TERMS: (lines `- source: rendering`)\n### VERIFIED TRANSLATION:"


def user_message(chunk: Column | str, lang: str, prev_target: Column | str | None = None, prev_source: Column | str | None = None, terms: Column | str | None = None) -> Column:
    """A chunk with what is known of the text before it; parts that are blank are left out."""
    name = T.LANGUAGES.get(lang.lower().strip(), lang.capitalize())

    def part(label: str, x: Column | str | None) -> Column:
        if x is None:
            return F.lit(None).cast("string")
        return F.when(T.strip(x) != "", F.concat(F.lit(label), T.strip(x), F.lit('\n"""')))

    block = F.when(T.strip(terms) != "", T.strip(terms)) if terms is not None else F.lit(None).cast("string")
    context = F.concat_ws("\n\n", part('[Source before this part, not to be translated again]:\n"""\n', prev_source), part(f'[{name} translation before this part, for its terms]:\n"""\n', prev_target), block)
    ask = F.concat(F.lit(f"Translate this part into {name}:\n\n"), T.text_of(chunk))
    return F.when(context == "", ask).otherwise(F.concat(context, F.lit("\n\n---\n\n"), ask))


def verify_message(source: Column | str, draft: Column | str) -> Column:
    return F.concat(F.lit("SOURCE:\n"), T.text_of(source), F.lit("\n\nDRAFT:\n"), T.text_of(draft))


def recovery_message(missing: Column, source: Column | str) -> Column:
    """Asks for the paragraphs whose tags are missing, and holds those only."""

    def lost(paragraphs: Column) -> Column:
        return F.array_join(F.transform(missing, lambda i: F.concat(F.lit("[P"), i.cast("string"), F.lit("]\n"), F.get(paragraphs, i - 1))), "\n\n")

    return F.concat(F.lit("These paragraphs have no translation. Translate them, each after its tag.\n\n"), align.once(align.paragraphs(T.clean_tags(source)), lost))


# the dry run, as expressions


def dry_run(chunks: DataFrame, cfg: Config, index: str = "chunk_index", total: str = "n_chunks") -> DataFrame:
    """chunks with `output`. Needs chunk_text, token_count, prev_context."""
    mark = " - VERIFIED" if cfg.verify else ""
    line = F.format_string(f"[DRY RUN - {cfg.language.upper()} ({cfg.domain}){mark}] Translated chunk %d/%d (%d tokens)", F.col(index) + 1, F.col(total), "token_count")
    if cfg.bilingual:
        return align.with_bilingual_markdown(chunks.withColumn("__line", line), "chunk_text", "__line", "output", cfg.strip_vowels, cfg.keep_shaddah).drop("__line")
    return chunks.withColumn("output", F.concat(line, F.format_string("\n\n(Antecedent context: %d chars)\n\n(Original %d chars)", F.length("prev_context"), F.length("chunk_text"))))


def join_outputs(chunks: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """by, output: a document's outputs in order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "output"))), lambda c: c["output"])
    return chunks.groupBy(*by).agg(F.array_join(parts, "\n\n").alias("output"))


def translate_dry(docs: DataFrame, cfg: Config = Config(), text: str = "text", profile: Profile = ARABIC) -> DataFrame:
    """Each document's dry-run output: its other columns but text, and `output`. All within the row; only consolidation of bilingual output leaves the JVM."""
    if cfg.bilingual:
        keep = [c for c in docs.columns if c != text]
        return join_outputs(dry_run(chunk_documents(docs, text, cfg.chunk_size, cfg.overlap, profile=profile), cfg), tuple(keep))
    from quire.operators.chunking import chunks

    mark = " - VERIFIED" if cfg.verify else ""

    def build(all_: Column) -> Column:
        return F.array_join(
            F.transform(all_, lambda c, i: F.format_string(f"[DRY RUN - {cfg.language.upper()} ({cfg.domain}){mark}] Translated chunk %d/%d (%d tokens)\n\n(Antecedent context: %d chars)\n\n(Original %d chars)", i + 1, F.size(all_), c["token_count"], F.length(c["prev_context"]), F.length(c["text"]))),
            "\n\n",
        )

    keep = [c for c in docs.columns if c != text]
    return docs.select(*keep, align.once(chunks(text, cfg.chunk_size, cfg.overlap, None, profile), build).alias("output"))


# real providers

#: (system prompt, user message) -> answer
Provider = Callable[[str, str], str]
# Signs of errors that may pass, fewer than a substring search over any message would take.
TRANSIENT = ("429", "500", "502", "503", "504", "rate limit", "overloaded", "resource_exhausted", "quota", "disconnected", "timeout", "timed out", "connection", "broken pipe", "unavailable")
TRANSIENT_TYPES = ("transport", "timeout", "network", "connect", "protocol", "http")
RETRIES, BACKOFF = 10, 4.0


def transient(error: BaseException) -> bool:
    return any(s in str(error).lower() for s in TRANSIENT) or any(s in c.__name__.lower() for c in type(error).__mro__ for s in TRANSIENT_TYPES)


def with_retries(call: Callable[[], str], retries: int = RETRIES, backoff: float = BACKOFF, sleep: Callable[[float], None] = time.sleep) -> str:
    """call(), again after 4, 8, 16 ... seconds and up to 2 more while it fails by errors that may pass."""
    for attempt in range(retries):
        try:
            return call()
        except Exception as error:
            if not transient(error) or attempt == retries - 1:
                raise
            sleep(backoff * 2**attempt + random.uniform(0, 2))
    raise ValueError("no tries")


def call(rows: DataFrame, provider: Provider, system: str, ask: str, answer: str, delay: float = 0.0, fallback: str | None = None) -> DataFrame:
    """rows with the provider's answers to their messages; fallback: the column that stands in for an answer whose call fails. Keep speculative execution off for paid calls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            answers = []
            for i, message in enumerate(pdf[ask]):
                try:
                    answers.append(with_retries(lambda message=message: provider(system, message)))
                except Exception:
                    if fallback is None:
                        raise
                    answers.append(pdf[fallback].iloc[i])
                if delay:
                    time.sleep(delay)
            yield pdf.assign(**{answer: answers})

    return rows.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{answer}` string")


@dataclass(frozen=True)
class Run:
    """What a run made. outputs: by, chunk_index, output, final. memory: the terms learned. entries: by, chunk_index (from 1), total_chunks, has_corrections, audit_notes, novel_terms of verified chunks."""

    outputs: DataFrame
    memory: DataFrame
    entries: DataFrame


MEMORY = "arabic string, target string, source_chunk int, seq bigint"
WAVE = "output string, final string, audit_notes string, novel_terms array<struct<arabic:string,target:string>>, has_corrections boolean"


def wave_messages(wave: DataFrame, last: DataFrame, memory: DataFrame, cfg: Config, by: str) -> DataFrame:
    """wave (by, chunk_index, chunk_text, prev_context) with `__ask`: the chunk, the end of the output before it (last: by, before), and the last terms settled."""
    block = terms.prompt_terms(memory, by=(by,)).withColumnRenamed("block", "__block")
    rows = wave.join(last, by, "left").join(block, by, "left")
    text = align.tagged("chunk_text") if cfg.bilingual else F.col("chunk_text")
    return rows.withColumn("__ask", user_message(text, cfg.target_lang, T.trailing_context("before", cfg.overlap), "prev_context", "__block")).drop("before", "__block")


def learned(done: DataFrame, memory: DataFrame, by: str) -> DataFrame:
    """memory with the terms that verified answers list, then those that the final texts explain; the first of a term stays."""
    of_audit = done.select(by, "chunk_index", F.posexplode("novel_terms").alias("pos", "t"), F.lit(0).alias("part"))
    of_text = done.select(by, "chunk_index", F.posexplode(F.transform(terms.text_terms("final"), lambda t: F.struct(t["arabic"], t["target"]))).alias("pos", "t"), F.lit(1).alias("part"))
    place = F.col("chunk_index").cast("bigint") * (1 << 32) + F.col("part").cast("bigint") * (1 << 31) + F.col("pos")
    new = of_audit.unionByName(of_text).select(by, F.col("t.arabic").alias("arabic"), F.col("t.target").alias("target"), (F.col("chunk_index") + 1).cast("int").alias("source_chunk"), place.alias("seq"))
    return terms.record(new, memory, (by,)).drop("is_new")


def translate_run(chunks: DataFrame, provider: Provider, cfg: Config, by: str = "doc_id", glossary: str = "", done: DataFrame | None = None, verifier: Provider | None = None, memory: DataFrame | None = None, folder: str | None = None) -> Run:
    """Chunks in waves: the first of every document, then the second of every document, and so on, as a chunk's message holds what the one before gave and what was learned up to it.

    A wave is one job over all documents; only the provider's call is Python. Its answers, recovered where tags are missing and verified if cfg.verify, are written to `folder` before the next wave begins, and so is the memory.
    A run that finds waves there goes on after them, if the same run wrote them (source, settings); a folder of another run is cleared. done: (by, chunk_index, output) of chunks that need no call.
    memory: by, arabic, target, source_chunk, seq of terms known before. Without a folder, one of the shared folder is used and left to its owner."""
    spark, kind = chunks.sparkSession, chunks.schema[by].dataType.simpleString()
    book = store.Folder(spark, folder or store.scratch(spark, "runs"))
    rows = chunks.select(by, "chunk_index", "chunk_text", "prev_context")
    n, source = rows.agg(F.max("chunk_index"), F.sum(F.xxhash64(by, "chunk_index", "chunk_text").cast("decimal(38,0)"))).first()
    waves = -1 if n is None else n
    same = {"source": str(source), "waves": waves, "target_lang": cfg.target_lang.lower(), "domain": cfg.domain.lower(), "bilingual": cfg.bilingual, "verify": cfg.verify}
    if book.load("manifest") != same:
        book.clear()
        book.save("manifest", same)
    system, check = system_prompt(cfg, glossary), verifier_prompt(cfg)
    none = F.array().cast("array<struct<arabic:string,target:string>>")
    memory = spark.createDataFrame([], f"{by} {kind}, {MEMORY}") if memory is None else memory
    last = spark.createDataFrame([], f"{by} {kind}, before string")
    made = []
    for i in range(waves + 1):
        if not book.has(f"wave-{i}"):
            wave = rows.where(F.col("chunk_index") == i)
            if done is not None:
                known = done.where(F.col("chunk_index") == i).select(by, F.col("output").alias("__known"))
                wave = wave.join(known, by, "left")
                kept = wave.where("__known is not null").select(by, "chunk_index", F.col("__known").alias("output"), F.col("__known").alias("final"), F.lit(None).cast("string").alias("audit_notes"), none.alias("novel_terms"), F.lit(None).cast("boolean").alias("has_corrections"))
                wave = wave.where("__known is null").drop("__known")
            told = call(wave_messages(wave, last, memory, cfg, by), provider, system, "__ask", "draft", cfg.chunk_delay).drop("__ask")
            told = book.put(f"draft-{i}", told)  # paid answers are read, never asked for twice
            if cfg.bilingual:
                told = recover_missing(told.withColumn("draft", T.sanitize("draft")), provider, cfg, output="draft")
            if cfg.verify:
                told = book.put(f"recovered-{i}", told)
                source_text = align.tagged("chunk_text") if cfg.bilingual else F.col("chunk_text")
                told = call(told.withColumn("__ask", verify_message(source_text, "draft")), verifier or provider, check, "__ask", "response", fallback="draft").drop("__ask")
                told = verify.verified_chunks(told).withColumnRenamed("verified", "final")
            else:
                told = told.withColumn("final", F.col("draft")).withColumns({"audit_notes": F.lit(None).cast("string"), "novel_terms": none, "has_corrections": F.lit(None).cast("boolean")})
            if cfg.bilingual:
                told = align.with_bilingual_markdown(told.withColumn("final", T.sanitize("final")), "chunk_text", "final", "output", cfg.strip_vowels, cfg.keep_shaddah)
            else:
                told = told.withColumn("output", F.col("final"))
            columns = [by, "chunk_index", *[c.split()[0] for c in ("output", "final", "audit_notes", "novel_terms", "has_corrections")]]
            told = told.select(*columns)
            book.put(f"wave-{i}", told if done is None else told.unionByName(kept))
        wave = book.get(f"wave-{i}")
        memory = book.get(f"memory-{i}") if book.has(f"memory-{i}") else book.put(f"memory-{i}", learned(wave, memory, by))
        last = wave.select(by, F.col("output").alias("before"))
        made.append(wave)
    every = reduce(DataFrame.unionByName, made) if made else spark.createDataFrame([], f"{by} {kind}, chunk_index int, {WAVE}")
    total = rows.groupBy(by).agg(F.count("*").cast("int").alias("total_chunks"))
    entries = every.where("has_corrections is not null").join(total, by).select(by, (F.col("chunk_index") + 1).alias("chunk_index"), "total_chunks", "has_corrections", "audit_notes", "novel_terms")
    return Run(every.select(by, "chunk_index", "output", "final"), memory, entries)


def translate_in_order(chunks: DataFrame, provider: Provider, cfg: Config, by: str = "doc_id", glossary: str = "", done: DataFrame | None = None, **options) -> DataFrame:
    """by, chunk_index, output of translate_run(); of bilingual runs the answers themselves, which the caller pairs."""
    out = translate_run(chunks, provider, cfg, by, glossary, done, **options).outputs
    return out.select(by, "chunk_index", (F.col("final") if cfg.bilingual else F.col("output")).alias("output"))


def recover_missing(rows: DataFrame, provider: Provider, cfg: Config, source: str = "chunk_text", output: str = "output") -> DataFrame:
    """rows with their lost paragraphs asked for once more and put after the answer; a call that fails leaves the answer as it is. Only rows that lack tags reach the provider."""
    need = rows.withColumn("__missing", align.missing_tags(source, output))
    lost = need.where(F.size("__missing") > 0).withColumn("__ask", recovery_message(F.col("__missing"), source)).withColumn("__none", F.lit(""))
    got = call(lost, provider, system_prompt(cfg), "__ask", "__more", fallback="__none")
    got = got.withColumn(output, F.when(F.col("__more") == "", F.col(output)).otherwise(F.concat(F.col(output), F.lit("\n\n"), T.sanitize("__more"))))
    return need.where(F.size("__missing") == 0).select(*rows.columns).unionByName(got.select(*rows.columns))

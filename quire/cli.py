"""Command line: python -m quire.cli COMMAND ..."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import normalize as N
from quire.functions import text as T
from quire.operators import align, layout, project, render, slicing, terms, translate, verify
from quire.operators.chunking import ARABIC, LATIN, chunk_documents
from quire.operators.translate import Config
from quire.sources import files, providers

PROFILES = {"arabic": ARABIC, "latin": LATIN}
#: Options by group: flag, and what argparse is told of it.
GROUPS: dict[str, tuple[tuple[tuple[str, ...], dict], ...]] = {
    "run": (
        (("--lang",), {"default": "en"}),
        (("--domain",), {"default": "mantiq"}),
        (("--provider",), {"default": "dry-run", "choices": ("dry-run", *providers.CALLS)}),
        (("--model",), {"default": ""}),
        (("--temperature",), {"type": float, "default": 0.2}),
        (("--chunk-size",), {"type": int, "default": 1500}),
        (("--overlap",), {"type": int, "default": 200}),
        (("--delay",), {"type": float, "default": 4.0}),
        (("--bilingual",), {"action": "store_true"}),
        (("--verify",), {"action": "store_true"}),
        (("--verifier-provider",), {"default": ""}),
        (("--verifier-model",), {"default": ""}),
        (("--glossary",), {"help": "a JSON file instead of the one found by language and domain"}),
        (("--glossaries",), {"default": "glossaries", "help": "folder of LANG/DOMAIN.json"}),
        (("--terms",), {"help": "terms of earlier sessions (JSON)"}),
        (("--save-terms",), {"help": "where the learned terms go"}),
        (("--audit",), {"help": "where the audit report goes"}),
        (("--folder",), {"help": "where a run keeps its state, to be resumed"}),
        (("--fresh",), {"action": "store_true", "help": "begin anew whatever the folder holds"}),
        (("--keep-vowels",), {"action": "store_true"}),
        (("--keep-shaddah",), {"action": "store_true"}),
        (("--profile",), {"choices": tuple(PROFILES), "default": "arabic"}),
    ),
    "pages": (
        (("--pages",), {}),
        (("--skip",), {"type": int}),
        (("--take",), {"type": int}),
        (("--chapter",), {}),
        (("--keep-headers",), {"action": "store_true"}),
        (("--keep-rubrics",), {"action": "store_true"}),
        (("--keep-footnotes",), {"action": "store_true", "help": "leave footnotes where they stand"}),
    ),
    "print": (
        (("--pdf",), {"help": "where the PDF goes"}),
        (("--title",), {"default": ""}),
        (("--subtitle",), {"default": ""}),
        (("--paper",), {"default": "iso-b5"}),
        (("--font",), {"default": ""}),
        (("--keep-markup",), {"action": "store_true"}),
    ),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quire")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, help: str, *groups: str, source: bool = True) -> argparse.ArgumentParser:
        c = commands.add_parser(name, help=help)
        if source:
            c.add_argument("input")
        for group in groups:
            for flags, told in GROUPS[group]:
                c.add_argument(*flags, **told)
        return c

    command("translate", "a text, DOCX or PDF file", "run", "pages", "print").add_argument("-o", "--output")
    c = command("chapters", "a file's chapters")
    c.add_argument("--profile", choices=tuple(PROFILES), default="arabic")
    c.add_argument("-o", "--output")
    command("audit", "issues of a bilingual Markdown file").add_argument("-o", "--output")
    command("typeset", "Typst markup, or a PDF, of a bilingual Markdown file", "print").add_argument("-o", "--output")
    command("glossaries", "languages and domains there are glossaries for", source=False).add_argument("--glossaries", default="glossaries")
    p = command("project", "a book, slice by slice", "run", "print", source=False)
    p.add_argument("action", choices=("init", "run", "status"))
    p.add_argument("manifest")
    p.add_argument("--source")
    p.add_argument("--adopt", help="a finished document that the project goes on from")
    p.add_argument("--adopt-pages", help="the pages it holds")
    p.add_argument("--pages")
    p.add_argument("--take", type=int)
    p.add_argument("--all", action="store_true")
    return out


def config(args) -> Config:
    return Config(
        provider=args.provider, target_lang=args.lang, domain=args.domain, model=args.model, verifier_model=args.verifier_model, verifier_provider=args.verifier_provider, temperature=args.temperature,
        chunk_size=args.chunk_size, overlap=args.overlap, chunk_delay=args.delay, verify=args.verify, bilingual=args.bilingual, strip_vowels=not args.keep_vowels, keep_shaddah=args.keep_shaddah,
    )


def glossary_block(spark: SparkSession, args, cfg: Config) -> str:
    """The prompt's glossary: the file that is given, or that the language and domain lead to."""
    path = args.glossary
    if not path:
        found = files.glossary_listing(spark, args.glossaries)
        asked = spark.createDataFrame([(None, cfg.target_lang, cfg.domain)], "path string, lang string, domain string")
        path = terms.resolve_glossary(asked, found).first().resolved
    row = terms.prompt_glossary(files.read_glossary(spark, path)).first() if path else None
    return row.block if row else ""


def rows_out(df: DataFrame, path: str | None) -> None:
    """All rows: as JSON lines in a folder, or printed one by one as they arrive."""
    if path:
        df.write.mode("overwrite").json(path)
    else:
        for line in df.toJSON().toLocalIterator():
            print(line)


def typeset(spark: SparkSession, args, markdown: str, path: str) -> None:
    issues = [f"{r.severity} line {r.line}: {r.description}" for r in align.audit_rows(spark.createDataFrame([(markdown,)], "text string")).toLocalIterator()]
    one = render.documents(spark.createDataFrame([(markdown,)], "text string"), title=args.title, subtitle=args.subtitle, lang=getattr(args, "lang", "en"), domain=getattr(args, "domain", "general"), paper=args.paper, font=args.font)
    written = render.write_pdf(one.first().typst, path, issues, args.keep_markup)
    print(written or f"no compiler: markup beside {path}")


def run_translate(spark: SparkSession, args) -> None:
    cfg, profile = config(args), PROFILES[args.profile]
    skip, take = slicing.page_range(args.pages, args.skip, args.take)
    options = layout.Options(not args.keep_headers, not args.keep_footnotes, not args.keep_rubrics)
    docs = files.read_documents(spark, args.input, skip, take, options=options).select(F.lit(1).cast("bigint").alias("doc_id"), "text")
    if args.chapter:
        docs = slicing.extract_chapter(docs, args.chapter, profile=profile).withColumnRenamed("chapter_text", "text").select("doc_id", "text")
    tag = spark.range(1).select(T.page_tag(F.lit(skip), F.lit(take).cast("int")).alias("t")).first().t
    output = args.output or spark.range(1).select(T.output_path(F.lit(args.input), F.lit(cfg.target_lang), F.lit(tag), F.lit(cfg.bilingual)).alias("p")).first().p
    if cfg.provider == "dry-run":
        out = translate.translate_dry(docs, cfg, profile=profile)
    else:
        chunks = chunk_documents(docs, "text", cfg.chunk_size, cfg.overlap, profile=profile)
        memory = files.read_terms(spark, args.terms).withColumn("doc_id", F.lit(1).cast("bigint")) if args.terms else None
        if args.fresh and args.folder:
            translate.store.Folder(spark, args.folder).clear()
        ask = providers.provider(cfg.provider, cfg.resolved_model, cfg.temperature, cfg.max_output_tokens)
        check = providers.provider(cfg.resolved_verifier_provider, cfg.resolved_verifier_model, cfg.temperature, cfg.max_output_tokens) if cfg.verify else None
        run = translate.translate_run(chunks, ask, cfg, glossary=glossary_block(spark, args, cfg), verifier=check, memory=memory, folder=args.folder)
        out = translate.join_outputs(run.outputs)
        if args.save_terms:
            files.write_terms(run.memory, args.save_terms)
        if cfg.verify:
            report = verify.audit_report(run.entries, cfg.target_lang, cfg.domain, cfg.resolved_model, cfg.provider, cfg.resolved_verifier_model)
            files.write_texts(report, args.audit or spark.range(1).select(T.audit_path(F.lit(output)).alias("p")).first().p, "report")
            rows_out(verify.corrected(run.entries), None)
    files.write_texts(out, output, "output")
    if args.pdf:
        typeset(spark, args, files.whole(spark, output), args.pdf)


def run_project(spark: SparkSession, args) -> None:
    if args.action == "init":
        book = project.Project(args.manifest, args.source or "", args.lang, args.domain, total_pages=files.pages_in(spark, args.source) if args.source else None)
        if args.adopt:
            skip, take = slicing.page_range(args.adopt_pages)
            book = project.adopt(book, files.whole(spark, args.adopt), skip + (take or 0), spark)
            book = replace(book, slices=(project.Slice(skip + 1, skip + take, len(book.document)),)) if take else book
        book.save(spark, args.manifest)
    else:
        book = project.Project.load(spark, args.manifest)
        if args.action == "run":
            cfg = replace(config(args), target_lang=book.target_lang, domain=book.domain, bilingual=book.bilingual)
            ask = None if cfg.provider == "dry-run" else providers.provider(cfg.provider, cfg.resolved_model, cfg.temperature, cfg.max_output_tokens)
            text = files.read_text(spark, book.source).select(N.normalize("text")).first()[0]
            book = project.continue_project(spark, book, text, cfg, args.pages, args.take, args.all, ask, PROFILES[args.profile], glossary=glossary_block(spark, args, cfg) if ask else "")
            book.save(spark, args.manifest)
            if args.pdf:
                typeset(spark, args, book.document, args.pdf)
    done = ", ".join(f"p{s.start_page}-{s.end_page}" for s in book.slices) or "none"
    print(f"{book.name}: next page {book.next_page} of {book.total_pages or 'unknown'}; slices {done}")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quire").getOrCreate()
    if args.command == "translate":
        run_translate(spark, args)
    elif args.command == "project":
        run_project(spark, args)
    elif args.command == "chapters":
        rows_out(slicing.chapter_rows(files.read_documents(spark, args.input), profile=PROFILES[args.profile]), args.output)
    elif args.command == "audit":
        rows_out(align.audit_rows(files.read_text(spark, args.input)), args.output)
    elif args.command == "glossaries":
        rows_out(terms.available_glossaries(files.glossary_listing(spark, args.glossaries)), None)
    elif args.pdf:
        typeset(spark, args, files.whole(spark, args.input), args.pdf)
    else:
        docs = files.read_text(spark, args.input)
        files.write_texts(render.documents(docs, title=args.title, subtitle=args.subtitle, paper=args.paper, font=args.font), args.output or f"{args.input}.typ", "typst")
    return 0


if __name__ == "__main__":
    sys.exit(main())

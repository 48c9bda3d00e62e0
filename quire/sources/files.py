"""Documents, glossaries and term memories from files, and the sinks."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from importlib.util import find_spec
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import normalize as N
from quire.operators import layout, slicing

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if its scan alone would be fewer tasks (a small input in one row group); as it is otherwise, so nothing is shuffled at scale."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(spark.conf.get("spark.sql.files.maxPartitionBytes").removesuffix("b"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * split else df


def kind_of(path: Column) -> Column:
    """text, docx or pdf by suffix; another suffix is an error."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(suffix.isin("txt", "md"), "text").when(suffix == "docx", "docx").when(suffix == "pdf", "pdf").otherwise(F.raise_error(F.concat(F.lit("no reader for "), path)).cast("string"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """path, text: whole UTF-8 files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def docx_text(content: bytes) -> str:
    """Paragraphs that aren't blank, with blank lines between."""
    root = ElementTree.parse(zipfile.ZipFile(io.BytesIO(content)).open("word/document.xml"))
    paragraphs = ("".join({f"{WORD}tab": "\t", f"{WORD}br": "\n"}.get(e.tag, e.text or "") if e.tag in (f"{WORD}t", f"{WORD}tab", f"{WORD}br") else "" for e in p.iter()) for p in root.iter(f"{WORD}p"))
    return "\n\n".join(p for p in paragraphs if p.strip())


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"path": pdf.path, "text": [docx_text(bytes(c)) for c in pdf.content]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, text string")


BLOCKS = "path string, page_id int, block_no int, block_type int, x0 double, y0 double, x1 double, y1 double, font_size double, text string"
#: What a PDF page is read into: its size (x1, y1), its text blocks, the ends of its drawn lines.
PARTS = f"kind string, {BLOCKS}"
BLUE = 0x24408F


def styled_block(spans: list[list[tuple[str, int, float]]]) -> tuple[str, float]:
    """(text, mean font size) of lines of (text, colour, size): a blue span among others becomes bold."""
    lines = ["".join(f"**{t.strip()}** " if c == BLUE and len(t.strip()) > 1 and len(line) > 1 else t for t, c, _ in line) for line in spans]
    sizes = [s for line in spans for t, _, s in line if t.strip()]
    return "\n".join(lines), sum(sizes) / len(sizes) if sizes else 12.0


def page_parts(path: str, number: int, page) -> list[tuple]:
    """PARTS rows of a page as the optional package gives it. A block that has no styled lines is taken as plain text."""
    rows = [("page", path, number, 0, 0, 0.0, 0.0, float(page.rect.width), float(page.rect.height), None, None)]
    plain = None
    for i, b in enumerate(page.get_text("dict").get("blocks", [])):
        if b.get("type", 0) != 0 or "lines" not in b:
            continue
        text, size = styled_block([[(s.get("text", ""), s.get("color", 0), s.get("size", 12.0)) for s in line.get("spans", []) if s.get("text")] for line in b["lines"]])
        if not text.strip():
            plain = plain or {tuple(map(round, p[:4])): p[4] for p in page.get_text("blocks")}
            text = plain.get(tuple(map(round, b["bbox"])), "")
        rows.append(("block", path, number, i, 0, *map(float, b["bbox"]), size, text))
    for d in page.get_drawings():
        for item in d.get("items", []):
            if item[0] == "l":
                rows.append(("line", path, number, 0, 0, float(item[1].x), float(item[1].y), float(item[2].x), float(item[2].y), None, None))
            elif item[0] == "re" and item[1].height < 2:
                rows.append(("line", path, number, 0, 0, float(item[1].x0), float(item[1].y0), float(item[1].x1), float(item[1].y1), None, None))
    return rows


def read_pdf_parts(spark: SparkSession, path: str) -> DataFrame:
    """PARTS rows of PDF files. Needs the optional `pymupdf` package."""
    if find_spec("pymupdf") is None:
        raise RuntimeError("PDF files need pymupdf; give a table of blocks to quire.operators.layout instead")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pymupdf

        for pdf in batches:
            for name, content in zip(pdf.path, pdf.content, strict=True):
                for number, page in enumerate(pymupdf.open(stream=bytes(content), filetype="pdf"), 1):
                    yield pd.DataFrame(page_parts(name, number, page), columns=[c.split()[0] for c in PARTS.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, PARTS)


def pdf_tables(parts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks, page sizes and dividers of PARTS rows, as the layout operators take them."""
    blocks = parts.where("kind = 'block'").drop("kind")
    pages = parts.where("kind = 'page'").select("path", "page_id", F.col("x1").alias("w"), F.col("y1").alias("h"))
    lines = parts.where("kind = 'line'").select("path", "page_id", F.col("x0").alias("x_a"), F.col("y0").alias("y_a"), F.col("x1").alias("x_b"), F.col("y1").alias("y_b")).join(pages.select("path", "page_id", "h"), ["path", "page_id"])
    return blocks, pages, layout.divider_lines(lines).select("path", "page_id", "lx0", "lx1", "ly")


def page_count(blocks: DataFrame, by: str = "path") -> DataFrame:
    return blocks.groupBy(by).agg(F.max("page_id").alias("pages"))


def read_documents(spark: SparkSession, path: str, skip: int = 0, take: int | None = None, normalize: bool = True, options: layout.Options = layout.Options()) -> DataFrame:
    """path, text of .txt, .md, .docx and .pdf files: normalised whole, then cut to pages (of PDF files, by their own pages)."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "pdf":
        return read_pdf(read_pdf_parts(spark, path), skip, take, options)
    if suffix not in ("txt", "md", "docx"):
        raise ValueError(f"no reader for {path}")
    docs = read_docx(spark, path) if suffix == "docx" else read_text(spark, path)
    docs = docs.withColumn("text", N.normalize("text")) if normalize else docs
    return docs.withColumn("text", slicing.slice_pages("text", skip, take)) if skip or take is not None else docs


def read_pdf(parts: DataFrame, skip: int = 0, take: int | None = None, options: layout.Options = layout.Options()) -> DataFrame:
    """path, text of PARTS rows: blocks in reading order, footnotes told apart by divider lines, marks and sizes."""
    parts = parts.where(F.col("page_id") > skip)
    blocks, pages, dividers = pdf_tables(parts if take is None else parts.where(F.col("page_id") <= skip + take))
    keys = ("path", "page_id")
    return layout.document_text(layout.page_texts(layout.classify(blocks, pages, dividers, keys, options), keys), ("path",), "page_id")


def whole(spark: SparkSession, path: str) -> str:
    """One document's text, on the driver."""
    return "\n".join(r.text for r in read_text(spark, path).toLocalIterator())


def pages_in(spark: SparkSession, path: str) -> int:
    """Pages of one file."""
    if path.lower().endswith(".pdf"):
        return page_count(read_pdf_parts(spark, path).where("kind = 'page'")).first().pages
    return read_documents(spark, path).select(F.size(slicing.pages("text")).alias("n")).first().n


def glossary_listing(spark: SparkSession, folder: str) -> DataFrame:
    """lang, domain, path of the glossaries in a folder (none if it is missing)."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/*/*.json")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
    rows = [(f.getPath().toString(),) for f in found]
    inside = spark.createDataFrame(rows, "path string")
    return inside.select(F.regexp_extract("path", r"([^/]+)/[^/]+\.json$", 1).alias("lang"), F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("domain"), "path")


def write_texts(docs: DataFrame, path: str, text: str = "text") -> None:
    docs.select(F.col(text).alias("value")).write.mode("overwrite").text(path)


def read_glossary(spark: SparkSession, path: str, lang: str = "en", domain: str = "general") -> DataFrame:
    """lang, domain, category, arabic, target, seq of {category: {source: target}} files; none for a missing file."""
    schema = "lang string, domain string, category string, arabic string, target string, seq bigint"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    data = F.from_json("value", "map<string,map<string,string>>")
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.map_entries(data)).alias("i", "c"))
    rows = rows.select("i", F.col("c.key").alias("category"), F.posexplode(F.map_entries("c.value")).alias("j", "t"))
    return rows.select(F.lit(lang).alias("lang"), F.lit(domain).alias("domain"), "category", F.col("t.key").alias("arabic"), F.col("t.value").alias("target"), (F.col("i").cast("bigint") * (1 << 32) + F.col("j")).alias("seq"))


def glossary_files(paths: DataFrame) -> DataFrame:
    """lang, domain, path of paths such as .../en/logic.json; a file in no folder of a language has null for both."""
    lang = F.regexp_extract("path", r"glossaries/([^/]+)/[^/]+\.json$", 1)
    return paths.select(F.nullif(lang, F.lit("")).alias("lang"), F.when(lang != "", F.regexp_extract("path", r"([^/]+)\.json$", 1)).alias("domain"), "path")


def terms_of_json(x: Column) -> Column:
    """array<struct<arabic, target>> of a memory's JSON text: {"session_terms": {...}} alone, or else source-target pairs, on the top or grouped by category, in order."""
    pair = "array<struct<arabic:string,target:string>>"

    @F.pandas_udf(pair)
    def parse(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[dict]:
            data = json.loads(text) if text else {}
            if not isinstance(data, dict):
                return []
            if isinstance(data.get("session_terms"), dict):
                data = data["session_terms"]
            found: dict[str, str] = {}
            for k, v in data.items():
                found.update(v if isinstance(v, dict) else {k: v} if isinstance(v, str) else {})
            return [{"arabic": k, "target": str(v)} for k, v in found.items()]

        return texts.map(one)

    return parse(x)


def read_terms(spark: SparkSession, path: str, source_chunk: int = 0) -> DataFrame:
    """arabic, target, source_chunk, seq: ready for terms.record()."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(terms_of_json(F.col("value"))).alias("seq", "t"))
    return rows.select("t.arabic", "t.target", F.lit(source_chunk).alias("source_chunk"), F.col("seq").cast("bigint").alias("seq"))


def write_terms(memory: DataFrame, path: str, include_static: bool = False) -> None:
    """One JSON file in order of seq. A session's terms are few."""
    rows = memory if include_static else memory.where("source_chunk >= 0")
    pairs = F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("seq", "arabic", "target"))), lambda t: F.struct(t["arabic"], t["target"])))
    rows.agg(F.to_json(F.struct(pairs.alias("session_terms"))).alias("value")).coalesce(1).write.mode("overwrite").text(path)



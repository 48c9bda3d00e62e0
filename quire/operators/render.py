"""Typst markup from bilingual Markdown, and the document around it. Compiling needs the optional `typst` package; without it the markup is written.

Markdown is read in three steps, each a function of the one before: lines become blocks (`blocks_of`), blocks become nodes, in which a source quote holds its translation (`nodes_of`), and each kind of
node has one emitter (`EMIT`). Words within a line are tokens of one pattern (`TOKEN`), again with one emitter for each kind, so escapes need no placeholders.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from importlib.util import find_spec
from itertools import count, groupby
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.functions import text as T
from quire.operators import align

# Marks of source quotes, words of callouts for scripture, rubric comments, definitions of footnotes.
SOURCE_LABEL = "الأصل العربي"
SCROLL = "📜"
SACRED = ("qur'an", "koran", "hadith", "riwayah", "profeten", "imam", "«", "»", "allah")
RUBRIC = re.compile(r"<!--\s*rubric:\s*(?P<comment>.*?)\s*-->|\[RUBRIC:\s*(?P<bracket>.*?)\]", re.I)
DEFINITION = re.compile(r"\[\^?(\d+)\]:\s*(.+)")
LEAST_ARABIC = 3
ORNAMENT = '\n#v(0.8em)\n#align(center)[#text(12pt, fill: rgb("#24408f"))[✦ ✦ ✦]]\n#v(0.8em)\n'
LABELS = {"mantiq": "Logic", "fiqh": "Jurisprudence", "aqida": "Theology", "akhlaaq": "Ethics", "tadabbur": "Reflection", "thaqafa": "Culture", "tarikh": "History", "general": "Scholarship"}


def typst_available() -> bool:
    return find_spec("typst") is not None


# words within a line

TOKEN = re.compile(
    r"(?P<kept>\\[$@<\[\]*`\\]|<!--.*?-->)"
    r"|`(?P<code>[^`\n]+)`"
    r"|\[\^?(?P<note>\d+)\]"
    r"|\*\*(?P<bold>.+?)\*\*"
    r"|\*(?P<italic>[^*\n]+)\*"
    r"|(?P<at>@)(?=[A-Za-z])"
    r"|(?P<lone>`)"
    r"|(?P<special>[$<*\[\]])"
)


def inline(text: str, notes: dict[str, str] | None = None, within: str = "") -> str:
    """Typst markup of a line's text. notes: what footnotes say; a reference to one of them becomes the footnote."""

    def emit(m: re.Match) -> str:
        kind, found = m.lastgroup, m[m.lastgroup]
        if kind == "note":
            return f"#footnote[{inline(notes[found], None, kind)}]" if notes and found in notes else rf"\[{m[0][1:-1]}\]"
        if kind in ("bold", "italic") and kind != within:
            mark = "*" if kind == "bold" else "_"
            return f"{mark}{inline(found, notes, kind)}{mark}"
        return {"kept": found, "code": f"`{found}`", "lone": "'"}.get(kind) or re.sub(r"([$@<*\[\]])", r"\\\1", m[0])

    return TOKEN.sub(emit, text)


# lines to blocks

KINDS: tuple[tuple[str, re.Pattern], ...] = (
    ("blank", re.compile(r"()$")),
    ("quote", re.compile(r">[> ]*(.*)")),
    ("note", DEFINITION),
    ("rule", re.compile(r"([-*_]{3,})$")),
    ("heading", re.compile(r"(#{1,5}) +(.*)")),
    ("number", re.compile(r"\d+\.\s+(.*)")),
    ("bullet", re.compile(r"- +(.*)")),
    ("text", re.compile(r"(.*)")),
)


@dataclass(frozen=True)
class Block:
    """A line: its kind, what the kind's pattern finds, and the line itself."""

    kind: str
    parts: tuple[str, ...]
    line: str


def blocks_of(markdown: str) -> list[Block]:
    out = []
    for line in markdown.splitlines():
        bare = line.strip()
        if not bare.startswith(">") and RUBRIC.search(bare):
            out.append(Block("rubric", (), bare))
            continue
        kind, found = next((k, m) for k, p in KINDS if (m := p.match(bare)))
        out.append(Block(kind, found.groups(), line))
    return out


# blocks to nodes


@dataclass
class Node:
    """`pair`: a source quote and the lines that translate it (none: it stands alone); `callout`: another quote; or a block's kind."""

    kind: str
    text: str
    lines: list[Block] = field(default_factory=list)


def rubrics_of(text: str) -> tuple[list[Node], str]:
    """The first rubric's title as a node, and the text without rubrics."""
    first = RUBRIC.search(text)
    title = (first["comment"] or first["bracket"] or "").strip() if first else ""
    return [Node("tab", title)] if title else [], RUBRIC.sub("", text).strip() if first else text


def is_source(text: str) -> bool:
    arabic, latin = len(re.findall(r"[؀-ۿ]", text)), len(re.findall(r"[A-Za-zÀ-ɏ]", text))
    return SCROLL in text or SOURCE_LABEL in text or LEAST_ARABIC <= arabic > latin


def nodes_of(blocks: list[Block]) -> list[Node]:
    """A quote is all its neighbouring lines. The translation of a source quote is the run of plain lines after it, behind blank lines and rubrics only."""
    runs = [(quote, list(run)) for quote, run in groupby((b for b in blocks if b.kind != "note"), key=lambda b: b.kind == "quote")]
    out: list[Node] = []
    source: Node | None = None
    for quote, run in runs:
        if quote:
            tabs, text = rubrics_of(" ".join(b.parts[0].strip() for b in run).strip())
            out += tabs
            source = Node("pair", re.sub(rf"^[{SCROLL}\s*]*\[?{SOURCE_LABEL}\]?[:\s*]*", "", text).strip()) if is_source(text) else None
            out.append(source or Node("callout", text))
            continue
        rest = run
        if source is not None:
            lead = next((i for i, b in enumerate(run) if b.kind not in ("blank", "rubric")), len(run))
            end = next((i for i, b in enumerate(run) if i >= lead and b.kind in ("blank", "rubric", "heading", "rule")), len(run))
            source.lines, source = run[lead:end], None
            out[-1:-1] = [tab for b in run[:lead] if b.kind == "rubric" for tab in rubrics_of(b.line)[0]]
            rest = run[end:]
        for b in rest:
            out += rubrics_of(b.line)[0] if b.kind == "rubric" else [Node(b.kind, b.line, [b])]
    return out


# nodes to markup


def guarded(line: str) -> str:
    """A line that begins like a Typst heading, escaped."""
    return re.sub(r"^(=+\s)", r"\\\1", line)


def translation_line(b: Block, write: Callable[[str], str]) -> str:
    return f"- {write(b.parts[0].strip())}" if b.kind == "bullet" else guarded(write(b.line.strip()))


def emit_pair(n: Node, write: Callable[[str], str]) -> str:
    if not n.text:
        return "\n".join(translation_line(b, write) for b in n.lines)
    if not n.lines:
        return f"\n#arabic_block[\n  {write(n.text)}\n]\n"
    target = "\n".join(translation_line(b, write) for b in n.lines).strip()
    return f"\n#bilingual_item[\n  {write(n.text)}\n][\n  {target}\n]\n"


def emit_callout(n: Node, write: Callable[[str], str]) -> str:
    name = "quran_callout" if any(w in n.text.lower() for w in SACRED) else "hawza_callout"
    return f"\n#{name}[\n  {write(n.text)}\n]\n"


EMIT: dict[str, Callable[[Node, Callable[[str], str]], str]] = {
    "pair": emit_pair,
    "callout": emit_callout,
    "tab": lambda n, write: f"\n#margin_tab[{write(n.text)}]\n",
    "rule": lambda n, write: ORNAMENT,
    "heading": lambda n, write: f"{'=' * len(n.lines[0].parts[0])} {write(n.lines[0].parts[1].strip())}",
    "number": lambda n, write: f"+ {write(n.lines[0].parts[0])}",
    "bullet": lambda n, write: f"- {write(n.lines[0].parts[0].strip())}",
    "blank": lambda n, write: "",
    "text": lambda n, write: guarded(write(n.text)),
}


def typst_of(markdown: str | None, strip_vowels: bool = True, keep_shaddah: bool = False) -> str:
    """Typst markup of Markdown that is sanitized and consolidated already."""
    text = markdown or ""
    if strip_vowels:
        text = re.sub(f"[{T.VOWELS_BUT_SHADDAH if keep_shaddah else T.VOWELS}]", "", text)
    blocks = blocks_of(text)
    notes = {b.parts[0]: b.parts[1].strip() for b in blocks if b.kind == "note"}
    write = lambda line: inline(line, notes)
    return "\n".join(EMIT[n.kind](n, write) for n in nodes_of(blocks))


def typst_content(x: Column | str, strip_vowels: bool = True, keep_shaddah: bool = False) -> Column:
    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: typst_of(align.consolidated(t), strip_vowels, keep_shaddah))

    return run(T.sanitize(x))


def fonts(chosen: str = "") -> list[str]:
    """Fonts for Arabic in order of preference, a chosen one first."""
    known = ["Amiri", "Dubai", "Scheherazade New", "Noto Naskh Arabic", "Traditional Arabic"]
    first = next((f for f in known if f.lower() == chosen.lower()), chosen)
    return ([first] if first else []) + [f for f in known if f != first]


def typst_document(content: str, title: str = "", subtitle: str = "", lang: str = "en", domain: str = "general", paper: str = "iso-b5", font: str = "") -> str:
    """A document around markup: page with running head and foot, fonts, a title page, and the blocks that the markup calls."""
    names = ", ".join(f'"{f}"' for f in fonts(font))
    quote = lambda s: s.replace("\\", "\\\\").replace('"', '\\"')
    size = T.PAPER.get(paper.lower().strip(), "iso-b5")
    label = LABELS.get(domain.lower(), domain.capitalize())
    head = f'#context if calc.even(counter(page).get().first()) [{label} #h(1fr)] else [#h(1fr) #"{quote(title)}"]'
    return "\n".join(
        [
            f'#set document(title: "{quote(title)}")',
            f'#set page(paper: "{size}", margin: (top: 2.4cm, bottom: 2.4cm, inside: 2.4cm, outside: 2cm), numbering: "1", header: [{head}])',
            f'#set text(lang: "{quote(lang)}", font: ("Libertinus Serif", {names}), size: 10.5pt)',
            "#set par(justify: true)",
            "#show heading: set block(above: 1.4em, below: 0.8em)",
            f"#let arabic_block(body) = block(width: 100%, inset: 8pt, fill: luma(245))[#set text(dir: rtl, lang: \"ar\", font: ({names},))\n#body]",
            "#let bilingual_item(source, target) = block(width: 100%)[#arabic_block(source)\n#target]",
            "#let hawza_callout(body) = block(width: 100%, inset: 8pt, stroke: (left: 2pt + gray))[#body]",
            "#let quran_callout(body) = block(width: 100%, inset: 8pt, stroke: (left: 2pt + rgb(\"#24408f\")))[#emph(body)]",
            "#let margin_tab(body) = place(right, dx: 1.5cm)[#text(8pt)[#body]]",
            f"#align(center)[#text(18pt, weight: \"bold\")[{inline(title)}]\\ {inline(subtitle) or label}]",
            "#pagebreak(weak: true)",
            "",
            content,
            "",
        ]
    )


def documents(docs: DataFrame, text: str = "text", title: str = "", **options) -> DataFrame:
    """docs with `typst`: a whole Typst file for each row, in one Python pass."""
    strip_vowels, keep_shaddah = options.pop("strip_vowels", True), options.pop("keep_shaddah", False)

    @F.pandas_udf(StringType())
    def whole(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: typst_document(typst_of(align.consolidated(t), strip_vowels, keep_shaddah), title, **options))

    return docs.withColumn("typst", whole(T.sanitize(text)))


def compile_pdf(markup: str) -> bytes | None:
    """The PDF, or None where the compiler isn't installed."""
    if not typst_available():
        return None
    import typst

    return typst.compile(markup.encode())


def free_names(path: Path):
    """The path, then names to fall back to while it is in use by another program."""
    yield path
    for n in count(1):
        yield path.with_name(f"{path.stem}_updated{'' if n == 1 else f'_{n}'}{path.suffix}")


def write_pdf(markup: str, path: str, issues: list[str] = (), keep_markup: bool = False, tries: int = 10, compiler: Callable[[str], bytes | None] = compile_pdf, say: Callable[[str], None] = print) -> Path | None:
    """Compile one document and write it on the driver: path, or one of its other names where that is locked. issues: what the audit found, told first. Without the compiler the markup is written instead."""
    for issue in issues:
        say(issue)
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    content = compiler(markup)
    if content is None or keep_markup:
        target.with_suffix(".typ").write_text(markup, encoding="utf-8")
    if content is None:
        return None
    for _, name in zip(range(tries), free_names(target), strict=False):
        try:
            name.write_bytes(content)
            return name
        except PermissionError as error:
            last = error
    raise last

"""Symbols from source texts: built-in regular expressions, and small parsers inside tasks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.manifests import library_symbols, twig_symbols, yaml_symbols
from tidemark.operators.php import Offsets, scan, tokens

SYMBOLS = (
    "file_path string, language string, symbol_type string, fqn string, name string, namespace string, parent_symbol string, visibility string, is_static int, "
    "signature_json string, signature_hash string, line_start int, line_end int, byte_start int, byte_end int, source_text string, docblock string, "
    "is_deprecated int, deprecation_version string, removal_version string, deprecation_message string, metadata_json string"
)
_COLUMNS = [x.split()[0] for x in SYMBOLS.split(", ")]
_ARROW = {"boolean": pa.bool_(), "string": pa.string(), "int": pa.int32(), "long": pa.int64()}


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _ARROW[t]) for n, t in (x.split() for x in ddl.split(", "))])


#: Rows that parsers of files give to Spark at once, and characters of text in them.
ROWS, CHARACTERS = 5_000, 4_000_000


def batched(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int] = lambda row: 0) -> Iterator[pa.RecordBatch]:
    """Record batches of ``ROWS`` rows, or of fewer once their ``size`` adds up to ``CHARACTERS``."""
    waiting, held = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*waiting, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        waiting.append(row)
        held += size(row)
        if len(waiting) >= ROWS or held >= CHARACTERS:
            yield batch()
            waiting, held = [], 0
    if waiting:
        yield batch()


def css_selectors(files: DataFrame) -> DataFrame:
    """(file_path, fqn, line_start, signature_hash) of class and id selectors, declarations left out."""
    # What is left out keeps its new lines, so that lines stay those of the file.
    pieces = lambda c, pattern: F.arrays_zip(F.split(c, pattern, -1).alias("kept"), F.regexp_extract_all(c, F.lit(f"({pattern})"), 1).alias("gone"))
    without = lambda c, pattern: F.array_join(F.transform(pieces(c, pattern), lambda x: F.concat(F.coalesce(x["kept"], F.lit("")), F.regexp_replace(F.coalesce(x["gone"], F.lit("")), "[^\n]", ""))), "")
    bare = without(without(F.col("text"), r"/\*(?s:.*?)\*/"), r"\{[^{}]*\}")
    lines = files.select("file_path", F.posexplode(F.split(bare, "\n")).alias("line", "t"))
    found = lines.select("file_path", (F.col("line") + 1).alias("line_start"), F.explode(F.regexp_extract_all("t", F.lit(r"([.#][A-Za-z_-][A-Za-z0-9_-]*)"), 1)).alias("fqn"))
    return found.withColumn("signature_hash", F.sha2("fqn", 256))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, href) of all links of html pages."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), 1)).alias("href"))


def deprecation(docblock: Column, package: str) -> Column:
    """Version, removal version and replacement that a docblock tells, null where it has no @deprecated."""
    take = lambda pattern: F.nullif(F.regexp_extract(docblock, pattern, 1), F.lit(""))
    found = F.struct(
        take(rf"@deprecated (?:in|since) {package}[: ](\d+\.\d+(?:\.\d+)?)").alias("version"),
        take(rf"removed from {package}:(\d+\.\d+\.\d+)").alias("removal_version"),
        F.trim(take(r"Use (.+?) instead")).alias("message"),
    )
    return F.when(docblock.contains("@deprecated"), found)


Parser = Callable[[str, str], Iterator[dict]]
PARSERS: dict[str, Parser] = {}


def parser(language: str) -> Callable[[Parser], Parser]:
    """Registers a (path, text) -> symbols function for a language; later ones replace earlier ones."""

    def register(f: Parser) -> Parser:
        PARSERS[language] = f
        return f

    return register


def symbols(files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """All symbols of (file_path, language, text) rows; languages without a parser give none.

    A file is parsed where it is read, and a text that can't be parsed has no symbols.
    """
    by_language = dict(PARSERS if parsers is None else parsers)

    schema, text_at = arrow_schema(SYMBOLS), _COLUMNS.index("source_text")

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if lang in by_language and text is not None:
                    yield from (tuple(row[c] for c in _COLUMNS) for row in _rows(path, lang, text, list(by_language[lang](path, text))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(parsed(batches), schema, lambda row: len(row[text_at] or ""))

    known = files.where(F.col("language").isin(*by_language)) if by_language else files
    return known.select("file_path", "language", "text").mapInArrow(run, SYMBOLS)


def _rows(path: str, language: str, text: str, found: list[dict]) -> list[dict]:
    """Symbols with places in bytes and lines, counted once over the text."""
    places, out = Offsets(text, [x[k] for x in found for k in ("start", "end") if x.get(k, -1) >= 0]), []
    for x in found:
        start, end = x.pop("start", -1), x.pop("end", -1)
        row = dict.fromkeys(_COLUMNS) | {"file_path": path, "language": language, "name": x["fqn"], "is_deprecated": 0} | x
        if start >= 0:
            row |= {"line_start": places.line(start), "line_end": places.line(max(start, end)), "byte_start": places.byte(start), "byte_end": places.byte(end)}
        row["signature_hash"] = row["signature_hash"] or hashlib.sha256("|".join(str(row[k]) for k in ("symbol_type", "fqn", "visibility", "signature_json")).encode()).hexdigest()
        out.append(row)
    return out


@parser("php")
def php_symbols(path: str, text: str) -> Iterator[dict]:
    """Classes, interfaces, traits, functions, methods, constants, events, hooks, plugins and event subscribers.

    Each has its place from first modifier to closing brace, its docblock, and what that or a
    triggered deprecation tells. Tokens decide: what stands in comments and strings is no code.
    """
    yield from scan(path, text).symbols


@parser("javascript")
def js_symbols(path: str, text: str) -> Iterator[dict]:
    for m in re.finditer(r"\bfunction\s+(?P<function>\w+)|\bclass\s+(?P<class>\w+)|\b(?:var|let|const)\s+(?P<variable>\w+)|^\s+(?!if|for|while|switch|catch|function)(?P<method>\w+)\s*\([^()]*\)\s*\{", text, re.M):
        kind = next(k for k, v in m.groupdict().items() if v)
        yield {"symbol_type": kind, "fqn": m[kind], "start": m.start(kind), "end": m.end(kind)}


PARSERS |= {"twig": twig_symbols, "yaml": yaml_symbols, "libraries": library_symbols}


_USAGE = "file_path string, fqn string, byte_start long, line_start long"
_LIBRARY = re.compile(r"\w+/[\w.-]+")
_TWIG_PART = re.compile(r"\{#.*?#\}|(\{[%{].*?[%}]\})", re.S)
_TWIG_TOKEN = re.compile(r"'(?>\\.|[^'\\])*+'|\"(?>\\.|[^\"\\])*+\"|\w+|\S", re.S)


def _attached_in_php(text: str) -> Iterator[tuple[str, int]]:
    """Strings that are put under a key ``library``: by an append, or in the list or alone behind an arrow."""
    code = [t for t in tokens(text) if t[0] not in ("comment", "doc")]
    for k, (kind, start, _, t) in enumerate(code):
        if kind != "string" or t.strip("\"'") != "library":
            continue
        after = [x[3] for x in code[k + 1 : k + 5]]
        if after == ["]", "[", "]", "="] and k + 5 < len(code) and code[k + 5][0] == "string":
            yield code[k + 5][3].strip("\"'"), code[k + 5][1] + 1
        elif after[:1] == ["=>"]:
            j, depth = k + 2, 0
            while j < len(code) and (code[j][3] in ("[", "]", ",", "array", "(", ")") or code[j][0] == "string"):
                depth += (code[j][3] in "[(") - (code[j][3] in "])")
                if code[j][0] == "string":
                    yield code[j][3].strip("\"'"), code[j][1] + 1
                if depth <= 0:
                    break
                j += 1


def _attached_in_twig(text: str) -> Iterator[tuple[str, int]]:
    """First arguments of attach_library in tags and outputs, comments left out."""
    for part in _TWIG_PART.finditer(text):
        if part[1]:
            words = list(_TWIG_TOKEN.finditer(part[1]))
            for name, opening, first in zip(words, words[1:], words[2:], strict=False):
                if name[0] == "attach_library" and opening[0] == "(" and first[0][0] in "'\"":
                    yield first[0][1:-1], part.start(1) + first.start() + 1


def _attached_in_yaml(text: str) -> Iterator[tuple[str, int]]:
    """Items of lists, by the nodes of the parsed text."""
    import yaml

    try:
        waiting = [yaml.compose(text, yaml.SafeLoader)]
    except yaml.YAMLError:
        return
    while waiting:
        node = waiting.pop()
        if isinstance(node, yaml.MappingNode):
            waiting += [v for _, v in node.value]
        elif isinstance(node, yaml.SequenceNode):
            waiting += node.value
            for item in node.value:
                if isinstance(item, yaml.ScalarNode):
                    yield item.value, item.start_mark.index + (item.style in ("'", '"'))


def library_usage(files: DataFrame) -> DataFrame:
    """(file_path, fqn, byte_start, line_start) of libraries that templates, code and lists in YAML attach.

    The file's name tells how it is read; a file of another kind, or one that can't be parsed, has none.
    """
    schema = arrow_schema(_USAGE)
    readers = ((".twig", _attached_in_twig), ((".yml", ".yaml"), _attached_in_yaml), ((".php", ".module", ".inc", ".install", ".theme", ".profile"), _attached_in_php))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                read = next((f for ends, f in readers if path and path.endswith(ends)), None)
                uses = {x for x in read(text) if _LIBRARY.fullmatch(x[0])} if read and text else set()
                places = Offsets(text or "", [p for _, p in uses])
                yield from ((path, fqn, places.byte(p), places.line(p)) for fqn, p in uses)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(found(batches), schema)

    return files.select("file_path", "text").mapInArrow(run, _USAGE).dropDuplicates(["file_path", "fqn", "byte_start"])

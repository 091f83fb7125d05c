"""Mechanical rewrites: templates on a matched piece of text, and edits of whole files."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.extract import arrow_schema, batched


def replace_text(source: Column, old: Column, new: Column) -> Column:
    return F.replace(source, old, new)


def insert_argument(source: Column, position: Column, value: Column) -> Column:
    """The first argument list without parentheses inside gets ``value`` at ``position``."""
    inside = F.regexp_extract(source, r"\(([^)]*)\)", 1)
    args = F.transform(F.split(inside, ","), lambda x: F.trim(x))
    place = F.least(position, F.size(args))
    joined = F.array_join(F.concat(F.slice(args, 1, place), F.array(value), F.slice(args, place + 1, F.greatest(F.size(args), F.lit(1)))), ", ")
    before = F.substring_index(source, "(", 1)
    rest = F.substr(source, F.length(before) + F.length(inside) + 2)
    return F.when(source.rlike(r"\([^)]*\)"), F.concat(before, F.lit("("), joined, rest)).otherwise(source)


def rewrite_call(source: Column, old: Column, new: Column) -> Column:
    """The first occurrence alone."""
    at = F.instr(source, old)
    return F.when(at > 0, F.concat(F.substring(source, F.lit(1), at - 1), new, F.substr(source, at + F.length(old)))).otherwise(source)


def use_getter(source: Column, property_: str, getter: str) -> Column:
    """Property reads become calls of the getter; what is called already stays."""
    return F.regexp_replace(source, rf"->\Q{property_}\E(?![A-Za-z0-9_])(?!\s*\()", f"->{getter}()")


def replace_word(source: Column, old: str, new: str) -> Column:
    return F.regexp_replace(source, rf"\b\Q{old}\E\b", new.replace("\\", "\\\\").replace("$", "\\$"))


def replace_global(source: Column, variable: str, replacement: str) -> Column:
    quoted = replacement.replace("\\", "\\\\").replace("$", "\\$")
    declared = F.regexp_replace(source, rf"global\s+\$\Q{variable}\E\s*;", f"\\${variable} = {quoted};")
    return F.regexp_replace(declared, rf"\$GLOBALS\s*\[\s*['\"]\Q{variable}\E['\"]\s*\]", quoted)


def block_diff(old: Column, new: Column, path: Column, line: Column) -> Column:
    """A diff that takes out all old lines and puts in all new ones."""
    marked = lambda text, mark: F.concat_ws("", F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit(mark), x, F.lit("\n"))))
    head = F.format_string("--- a/%s\n+++ b/%s\n@@ -%d,%d +%d,%d @@\n", path, path, line, F.size(F.split(old, "\n")), line, F.size(F.split(new, "\n")))
    return F.concat(head, marked(old, "-"), marked(new, "+"))


def split_arguments(call: str) -> list[str]:
    """Top-level arguments of the first call in a piece of code."""
    begin = call.find("(")
    if begin < 0:
        return []
    depth, quote, out, now = 0, "", [], ""
    for c in call[begin:]:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "([{":
            depth += 1
            if depth == 1:
                continue
        elif c in ")]}":
            depth -= 1
            if not depth:
                break
        elif c == "," and depth == 1:
            out.append(now.strip())
            now = ""
            continue
        now += c
    return [*out, now.strip()] if now.strip() else out


def rewritten(source: str, template: str | None) -> str | None:
    """A matched piece after its JSON template; None for an unknown template."""
    t = json.loads(template) if template else {}
    old, new = t.get("old", ""), t.get("new", "")
    kind = t.get("type")
    if kind in ("function_rename", "string_replace"):
        return source.replace(old, new) if old else source
    if kind == "namespace_move":
        a, b = t.get("old_namespace", ""), t.get("new_namespace", "")
        return source.replace(a, b).replace(a.replace("\\", "\\\\"), b.replace("\\", "\\\\")) if a else source
    if kind == "parameter_insert":
        found = re.search(r"\(([^)]*)\)", source)
        if not found:
            return source
        args = [x.strip() for x in found[1].split(",")]
        args.insert(t.get("position", 0), t.get("value", "NULL"))
        return source[: found.start(1)] + ", ".join(args) + source[found.end(1) :]
    if kind == "function_call_rewrite":
        return source.replace(old, new, 1) if old and new else source
    if kind == "method_chain":
        args, chain = split_arguments(source), t.get("chain") or []
        if not t.get("object") or not chain:
            return source
        calls = (f"->{m}({', '.join(args[i] for i in (t.get('args_map') or {}).get(m, []) if i < len(args))})" for m in chain)
        return t["object"] + "".join(calls)
    if kind == "variable_access" and t.get("property") and t.get("getter"):
        return re.sub(rf"->{re.escape(t['property'])}(?!\s*\()", lambda _: f"->{t['getter']}()", source)
    if kind == "constant_replace" and old and new:
        return re.sub(rf"\b{re.escape(old)}\b", lambda _: new, source)
    if kind == "global_replace" and t.get("variable") and t.get("replacement"):
        name = re.escape(t["variable"])
        source = re.sub(rf"global\s+\${name}\s*;", lambda _: f"${t['variable']} = {t['replacement']};", source)
        return re.sub(rf"\$GLOBALS\s*\[\s*['\"]{name}['\"]\s*\]", lambda _: t["replacement"], source)
    return source if kind in ("variable_access", "constant_replace", "global_replace") else None


_APPLIED = "file_path string, match_id long, status string, conflict boolean, new_text string"


def apply_edits(files: DataFrame, matches: DataFrame) -> DataFrame:
    """Every match's status, and once a file its rewritten text (on the row of its first match).

    ``files``: file_path, text. ``matches``: file_path, id, byte_start, byte_end (-1:
    unknown), matched_source, fix_template. A file's edits go from its end to its start
    over UTF-8 bytes; one fails where the bytes are not what was matched and what was
    matched is not there just once, or where it overlaps one that was applied (a
    conflict); one that changes nothing is skipped. A file's matches are collected first, so
    that its text is joined once; a task walks one file's matches.
    """
    places = (F.coalesce(c, F.lit(-1)).alias(c) for c in ("byte_start", "byte_end"))
    edits = matches.groupBy("file_path").agg(F.collect_list(F.struct("id", *places, "matched_source", "fix_template")).alias("edits"))
    return files.select("file_path", "text").join(edits, "file_path").mapInArrow(_applied_batches, _APPLIED)


def _applied_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files are walked one at a time: of a batch's texts, old and new, only a few are Python's at once."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for path, text, found in zip(*batch.columns, strict=True):
                for x in _walk((text.as_py() or "").encode(), found.as_py()):
                    yield path.as_py(), *x

    yield from batched(rows(), arrow_schema(_APPLIED), lambda row: len(row[4] or ""))


def _walk(data: bytes, found: list[dict]) -> list[list]:
    """[match id, status, conflict, text] of a file's edits from its end to its start; the text on the first alone.

    What lies behind the last edit is kept in pieces and joined once; only an edit whose place
    isn't known needs the text as it has become.
    """
    least = len(data) + 1  # where the nearest edit that was applied at its own place starts
    end, behind = len(data), []  # the text is data[:end] and, in reverse, what is behind
    rows: list[list] = []
    for m in sorted(found, key=lambda m: (-m["byte_start"], m["id"])):
        old, a, b = (m["matched_source"] or "").encode(), m["byte_start"], m["byte_end"]
        new = rewritten(m["matched_source"] or "", m["fix_template"])
        status, conflict = "failed", 0 <= a < b and b > least
        if not conflict and new is not None:
            known = a >= 0 and b <= end and data[a:b] == old
            if not known:
                data = data[:end] + b"".join(reversed(behind))
                end, behind = len(data), []
                a = data.find(old) if old and data.count(old) == 1 else -1
            if a >= 0 and new.encode() == old:
                status = "skipped"
            elif a >= 0:
                status = "applied"
                behind += [data[a + len(old) : end], new.encode()]
                end = a
                if known:
                    least = a
                else:
                    data = data[:end] + b"".join(reversed(behind))
                    end, behind = len(data), []
        rows.append([m["id"], status, conflict, None])
    rows[0][3] = (data[:end] + b"".join(reversed(behind))).decode()
    return rows


def edit_totals(applied: DataFrame) -> DataFrame:
    one = lambda s: F.count_if(F.col("status") == s).alias(s)
    changed = F.count_distinct(F.when(F.col("status") == "applied", F.col("file_path"))).alias("files_changed")
    return applied.agg(F.count("*").alias("total"), one("applied"), one("skipped"), one("failed"), F.count_if("conflict").alias("conflicts"), changed)

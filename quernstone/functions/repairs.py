"""Repair and reshaping of JSON: relaxed reading, schema inlining, type inference, argument maps, edits by line hash, diffs, text cleaning."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship
from ..sources.tables import table
from .structured import Changes, apply_edits, canonical, line_hashes, repaired, text_lines, unified
from .words import single

# Keywords that tell a schema's type, in order; characters of no width; punctuation of which a run of three and more is one; symbols that are pictures.
_STRUCTURE = (
    ("object", ("properties", "additionalProperties", "patternProperties", "required", "propertyNames", "minProperties", "maxProperties")),
    ("array", ("items", "prefixItems", "minItems", "maxItems", "uniqueItems", "contains")),
    ("string", ("minLength", "maxLength", "pattern", "format")),
    ("number", ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf")),
)
_NO_WIDTH = re.compile("[​-‍﻿⁠­͏᠋-᠍︀-️]")
_PICTURES = "\U0001f1e0-\U0001f1ff\U0001f300-\U0001f64f\U0001f680-\U0001faff☀-➿Ⓜ-⓿\U0001f100-\U0001f251"
_PICTURE = re.compile(f"[{_PICTURES}](?:[{_PICTURES}️⃣]|‍[{_PICTURES}])*")
_KEYCAP = re.compile("([0-9#*])️?⃣")
_ESCAPE = re.compile(r"\x1b(?:\[[0-?]*[ -/]*[@-~]|[@-Z\\-_])")
_MARKS = re.compile(r"([!?.,;:~。，！？；：、…])[!?.,;:~。，！？；：、…]{2,}")
_CODE = re.compile(r"```[\s\S]*?(?:```|\Z)|`[^`\n]+`")
_FAULTY = re.compile("[\ud800-\udfff�﷐-﷯-\U000f0000-\U000ffffd\U00100000-\U0010fffd]|[" + "".join(chr(p << 16 | x) for p in range(17) for x in (0xFFFE, 0xFFFF)) + "]")


class _Loose:
    """Reads JSON with single quotes, bare keys and words, comments, trailing or missing commas, Python's names, and missing closings."""

    _SKIP = re.compile(r"(?:\s+|//[^\n]*|#[^\n]*|/\*[\s\S]*?(?:\*/|\Z))+")
    _NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?(?![\w.])")
    _BARE = re.compile(r"[^\s,:\[\]{}\"']+")
    _NAMES = {"true": True, "True": True, "false": False, "False": False, "null": None, "None": None, "undefined": None, "NaN": None}
    _ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}

    def __init__(self, text: str):
        self.s, self.i = text, 0

    def peek(self) -> str:
        m = self._SKIP.match(self.s, self.i)
        self.i = m.end() if m else self.i
        return self.s[self.i : self.i + 1]

    def value(self):
        c = self.peek()
        if c in ("{", "["):
            return self.container(c)
        if c in ("'", '"'):
            return self.string(c)
        m = self._NUMBER.match(self.s, self.i)
        if m:
            self.i = m.end()
            return int(m[0]) if re.fullmatch(r"[-+]?\d+", m[0]) else float(m[0])
        m = self._BARE.match(self.s, self.i)
        if not m:
            raise ValueError(f"nothing to read at {self.i}")
        self.i = m.end()
        return self._NAMES.get(m[0], m[0])

    def container(self, opened: str):
        self.i += 1
        out = {} if opened == "{" else []
        while (c := self.peek()) not in ("}", "]", ""):
            if c in ",:":
                self.i += 1
                continue
            got = self.value()
            if opened == "[":
                out.append(got)
            elif self.peek() == ":":
                self.i += 1
                out[got if isinstance(got, str) else json.dumps(got)] = None if self.peek() in (",", "}", "") else self.value()
            else:
                raise ValueError(f"a key without a value at {self.i}")
        self.i += 1
        return out

    def string(self, mark: str) -> str:
        self.i += 1
        out = []
        while self.i < len(self.s):
            c = self.s[self.i]
            self.i += 1
            if c == mark:
                break
            if c == "\\" and self.i < len(self.s):
                c = self.s[self.i]
                self.i += 1
                if c == "u" and re.match("[0-9a-fA-F]{4}", self.s[self.i : self.i + 4]):
                    c, self.i = chr(int(self.s[self.i : self.i + 4], 16)), self.i + 4
                else:
                    c = self._ESCAPES.get(c, c)
            out.append(c)
        return "".join(out)


def loads(text: str | None):
    """The JSON value of a text, as it stands or else read loosely; ValueError where there is none."""
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        pass
    reader = _Loose(text or "")
    got = reader.value()
    if reader.peek():
        raise ValueError(f"more text at {reader.i}")
    return got


def relaxed(text: str | None) -> str | None:
    """Canonical JSON of a loosely written text, null where nothing can be read."""
    try:
        return canonical(json.dumps(loads(text), ensure_ascii=False))
    except (ValueError, RecursionError):
        return None


def inlined(schema: dict) -> dict:
    """A schema with its local references replaced by what they name; other keys beside a reference give way to it. Definitions go.

    A reference that leads back to itself is an error, as is one that names nothing or no object.
    """

    def named(pointer: str):
        at = schema
        for part in pointer.lstrip("#/").split("/"):
            if not isinstance(at, dict) or part not in at:
                raise ValueError(f"{pointer} names nothing")
            at = at[part]
        return at

    def open_(node, above: tuple[str, ...]):
        if isinstance(node, list):
            return [open_(x, above) for x in node]
        if not isinstance(node, dict):
            return node
        pointer = node.get("$ref")
        if isinstance(pointer, str):
            if not pointer.startswith("#"):
                return node
            if pointer in above:
                raise ValueError(f"{pointer} leads back to itself")
            target = open_(named(pointer), (*above, pointer))
            if not isinstance(target, dict):
                raise ValueError(f"{pointer} names no object")
            return {k: v for k, v in node.items() if k != "$ref"} | target
        return {k: open_(v, above) for k, v in node.items() if above or k not in ("$defs", "definitions") or node is not schema}

    return open_(schema, ())


def value_type(value) -> str:
    if value is None:
        return "null"
    return {bool: "boolean", int: "integer", float: "number", str: "string", dict: "object", list: "array"}[type(value)]


def inferred_type(values: list) -> str:
    """The one type of all values; whole numbers beside others are numbers, other mixtures strings."""
    kinds = {value_type(v) for v in values}
    if len(kinds) == 1:
        return kinds.pop()
    return "number" if kinds == {"integer", "number"} else "string"


def schema_type(node: dict) -> str:
    """Of a schema without a type: by enum or const, else by its keywords, else a string."""
    if "enum" in node or "const" in node:
        return inferred_type(node.get("enum") or [node.get("const")])
    return next((kind for kind, words in _STRUCTURE if any(w in node for w in words)), "string")


def clamped(value, least=None, most=None, least_in: bool = True, most_in: bool = True):
    """A number within its bounds; a whole number moves one further from a whole bound that it must not reach."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return value
    for bound, inside, sign in ((least, least_in, 1), (most, most_in, -1)):
        if bound is not None and (sign * value < sign * bound or (not inside and value == bound)):
            value = bound + sign if not inside and isinstance(value, int) and isinstance(bound, int) else bound
    return value


def sanitized(text: str) -> str:
    """NFKC, no characters of no width, no pictures, one mark of three and more, one blank; code in backticks stays as it is."""
    codes = _CODE.findall(text)
    parts = [unicodedata.normalize("NFKC", p) for p in _CODE.split(text)]
    plain = [_MARKS.sub(r"\1", _PICTURE.sub("", _NO_WIDTH.sub("", p))) for p in parts]
    plain = [re.sub(r"[^\S\n]+", " ", p) for p in plain]
    out = plain[0] + "".join(c + p for c, p in zip(codes, plain[1:]))
    return out.strip()


def cased(text: str, mode: str = "keep", most: int = 0) -> str:
    """In lower or title case but for code in backticks, then cut to `most` characters (0: not)."""
    turn = {"lower": str.lower, "title": str.title}.get(mode)
    if turn:
        codes = _CODE.findall(text)
        parts = [turn(p) for p in _CODE.split(text)]
        text = parts[0] + "".join(c + p for c, p in zip(codes, parts[1:]))
    return text[:most] if most > 0 else text


def valid(text: str, most: int = 100) -> str:
    """Without characters that stand for nothing, runs of one character cut to `most`."""
    return re.sub(rf"(.)\1{{{most},}}", lambda m: m[1] * most, _FAULTY.sub("", text))


def plain_output(text: str) -> str:
    """Without terminal codes, pictures and key caps (their digit stays)."""
    return _KEYCAP.sub(r"\1", _PICTURE.sub("", _ESCAPE.sub("", text)))


def hash_diff(old: str, new: str, around: int = 5) -> str:
    """Changed lines of the new text with their hashes, `around` lines about them, "..." between stretches; deleted ones stand by the number that they had."""
    a, b = text_lines(old), text_lines(new)
    marks = line_hashes(new)
    added: set[int] = set()
    gone: set[int] = set()
    for tag, i, j, k, m in Changes(a, b).get_opcodes():
        if tag != "equal":
            gone |= set(range(i + 1, j + 1))
            added |= set(range(k + 1, m + 1))
    near = sorted({n for x in added or {1} for n in range(max(1, x - around), min(len(b), x + around) + 1)})
    out, before = [], None
    for n in near:
        if before is not None and n > before + 1:
            out.append("...")
        before = n
        if n in gone:
            out.append(f"-{n}#  :{a[n - 1]}")
        if n in added or n not in gone:
            out.append(f"{'+' if n in added else ' '}{n}#{marks[n - 1]}:{b[n - 1]}")
    return "\n".join(out)


#: Rows that are made into Python objects at once.
SOME = 128


def mapped(rows: DataFrame, fn, schema: str) -> DataFrame:
    """fn over the rows as dicts, SOME at a time: a task holds an Arrow batch of its input, and of objects and results only these."""
    ship(rows.sparkSession)
    names, kinds = zip(*[c.split() for c in schema.split(", ")])
    types = [{"long": pa.int64(), "string": pa.string()}[k] for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SOME):
                done = zip(*[fn(r) for r in batch.slice(at, SOME).to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(done, types)], list(names))

    return rows.mapInArrow(run, schema)


def q_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties in several loose spellings, read again."""
    ship(spark)
    k, e = F.get_json_object("props", "$.k"), F.col("event_id") % 6
    loose = (
        F.when(e == 0, F.concat(F.lit("{'k': "), k, F.lit(", 'ok': True,}"))).when(e == 1, F.concat(F.lit("{k: "), k, F.lit(" /* note */, ok: true}"))).when(e == 2, F.concat(F.lit('{"k": '), k, F.lit(', "ok": true')))
        .when(e == 3, F.concat(F.lit('{"k": '), k, F.lit(' "ok": true} // end'))).when(e == 4, F.concat(F.lit("]"), k)).otherwise(F.concat(F.lit('{"ok": true, "k": '), k, F.lit("}")))
    )
    return table(spark, sf_dir, "events").select("event_id", single(relaxed)(loose).alias("json"))


def q_inlined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema for each nation, its name behind two references."""
    ship(spark)
    schema = F.concat(F.lit('{"$defs": {"N": {"const": "'), F.trim("n_name"), F.lit('"}, "P": {"$ref": "#/$defs/N"}}, "properties": {"a": {"$ref": "#/$defs/P"}, "b": [{"$ref": "http://x"}]}}'))
    open_ = single(lambda s: json.dumps(inlined(json.loads(s)), sort_keys=True, separators=(",", ":")))
    return table(spark, sf_dir, "nation").select("n_nationkey", open_(schema).alias("schema"))


def q_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of each user's values, by the spelling of what the events carry."""
    ship(spark)
    k, u = F.get_json_object("props", "$.k").cast("long"), F.col("user_id") % 5
    value = F.when(u == 0, k.cast("string")).when(u == 1, F.when(k % 2 == 0, k.cast("string")).otherwise(F.concat(k.cast("string"), F.lit(".5")))).when(u == 2, F.lit("true")).when(u == 3, F.when(k % 2 == 0, F.lit("true")).otherwise(k.cast("string"))).otherwise(F.concat(F.lit('"'), k.cast("string"), F.lit('"')))
    infer = single(lambda a: inferred_type([json.loads(x) for x in a]))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(value).alias("v")).select("user_id", infer("v").alias("type"))  # different values of a user


def q_schema_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    kinds = ('{"properties": {}}', '{"items": {}}', '{"pattern": "x"}', '{"maximum": 3}', "{}", '{"enum": [1, 2.5]}', '{"const": null}')
    node = F.element_at(F.array(*map(F.lit, kinds)), (F.col("n_nationkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "nation").select("n_nationkey", single(lambda s: schema_type(json.loads(s)))(node).alias("type"))


def q_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts within 10 and 90, the upper bound excluded, in built-in functions."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", F.least(F.greatest(k, F.lit(10)), F.lit(90 - 1)).alias("k"))


def q_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Argument maps with an alias, a misspelling and a number out of bounds."""
    fields, aliases = {"file_path": None, "timeout": (1, 60), "pattern": None}, {"path": "file_path"}

    def fix(row: dict) -> tuple:
        key = ("path", "file_pth", "file_path")[row["event_id"] % 3]
        got = repaired({key: f"f{row['k']}", "timeot" if row["event_id"] % 2 else "timeout": row["k"], "x": 1}, fields, aliases)
        return row["event_id"], json.dumps(got, sort_keys=True)

    rows = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return mapped(rows, fix, "event_id long, args string")


def q_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their first line replaced by two and a line put in front of the second, both by line hash, given twice."""

    def edit(row: dict) -> tuple:
        text, marks = row["text"] or "", line_hashes(row["text"])
        edits = [{"line": 1, "end": 1, "hash": marks[0], "lines": ["A", "B"]}] * 2
        if len(marks) > 1:
            edits.append({"line": 2, "end": 1, "hash": marks[1], "lines": ["C"]})
        try:
            return row["doc_id"], apply_edits(text, edits)
        except ValueError as e:
            return row["doc_id"], str(e)

    got = mapped(table(spark, sf_dir, "documents").select("doc_id", "text"), edit, "doc_id long, text string")
    return got.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


def q_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against themselves with the first line replaced by another: lines that a unified diff and a diff by hashes show."""

    def diff(row: dict) -> tuple:
        text = row["text"] or ""
        first = text.split("\n", 1)[0]
        put = "NEWER" if first == "NEW" else "NEW"
        new = put + text[len(first) :]
        shown, marked = unified(text, new).split("\n")[2:], hash_diff(text, new).split("\n")  # without the two lines of the header
        return row["doc_id"], sum(x.startswith("-") for x in shown), sum(x == f"+{put}" for x in shown), sum(x.startswith("+1#") and x.endswith(f":{put}") for x in marked)

    return mapped(table(spark, sf_dir, "documents").select("doc_id", "text"), diff, "doc_id long, removed long, added long, marked long")


def q_sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages with full-width letters, pictures, runs of marks and code around them."""
    ship(spark)
    dirty = F.concat(F.lit("Ｎｏ​ １!!! 😀👍🏽 `a  b???` "), F.regexp_replace("text", r"\s+", "   "), F.lit("\t???"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(single(sanitized)(dirty).cast("binary")).alias("digest"))


def q_cased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages in lower case behind code that keeps its case, cut."""
    ship(spark)
    text = F.concat(F.lit("Run `Make ALL` in ```\nA B\n``` Then "), "text")
    return table(spark, sf_dir, "benchmark").select("item_id", single(lambda t: cased(t, "lower", 100))(text).alias("text"))


def q_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages with a private character, a replacement character and a run of 150 letters."""
    ship(spark)
    dirty = F.concat(F.lit(""), F.repeat(F.lit("z"), 150), F.lit("�"), "text")
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(single(valid)(dirty).cast("binary")).alias("digest"))


def q_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Program output with colours, a cursor code, pictures and a key cap."""
    ship(spark)
    noisy = F.concat(F.lit("\x1b[1;31m"), "text", F.lit("\x1b[0m\x1bM 😀👨‍👩‍👧 1️⃣ ☀️ end"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(single(plain_output)(noisy).cast("binary")).alias("digest"))


def q_normal_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content parts by what they carry, also inside subagents' events; arguments in one spelling, as they are where they are no JSON."""
    e, k = table(spark, sf_dir, "events"), F.get_json_object("props", "$.k").cast("long")
    part = F.to_json(F.struct(F.when(k % 2 == 0, "text").otherwise("think").alias("type")))
    raw = F.when(k % 3 == 0, F.concat(F.lit('{"type":"SubagentEvent","event":{"type":"ContentPart","payload":'), part, F.lit("}}"))).when(k % 3 == 1, F.concat(F.lit('{"type":"ContentPart","payload":'), part, F.lit("}"))).otherwise(F.lit('{"type":"StepBegin"}'))
    rows = e.select("event_id", raw.alias("raw"), F.when(k % 4 == 0, F.lit("{broken")).otherwise(F.concat(F.lit('{ "k" :  '), k.cast("string"), F.lit("}"))).alias("args"))
    of = lambda path: F.get_json_object("raw", path)
    named = lambda kind, payload: F.when(of(kind) != "ContentPart", of(kind)).when(of(payload) == "think", "ThinkPart").otherwise("TextPart")
    tidy = F.coalesce(F.to_json(F.try_parse_json("args")), "args")
    return rows.select("event_id", named("$.type", "$.payload.type").alias("type"), F.when(of("$.event").isNotNull(), named("$.event.type", "$.event.payload.type")).alias("inner"), tidy.alias("args"))


_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
QUERIES = {
    "a09_relaxed_json": q_relaxed, "c20_inlined_schema": q_inlined, "c21_inferred_types": q_types, "c21_schema_types": q_schema_types, "c19_clamp": q_clamp, "c18_argument_repair": q_repair, "c29_hash_edits": q_edits, "c28_c30_diffs": q_diff,
    "c16_sanitized": q_sanitized, "c15_valid_text": q_valid, "c17_cased": q_cased, "c22_program_output": q_output, "c35_c36_event_types": q_normal_types,
}
ORACLES = {
    "a09_relaxed_json": f"SELECT event_id, CASE WHEN event_id % 6 <> 4 THEN '{{\"k\":' || {_K} || ',\"ok\":true}}' END AS json FROM events",
    "c20_inlined_schema": """SELECT n_nationkey, '{"properties":{"a":{"const":"' || trim(n_name) || '"},"b":[{"$ref":"http://x"}]}}' AS schema FROM nation""",
    "c21_inferred_types": f"SELECT user_id, CASE user_id % 5 WHEN 0 THEN 'integer' WHEN 1 THEN CASE WHEN bool_and(k % 2 = 0) THEN 'integer' ELSE 'number' END WHEN 2 THEN 'boolean' WHEN 3 THEN CASE WHEN bool_and(k % 2 = 0) THEN 'boolean' WHEN bool_or(k % 2 = 0) THEN 'string' ELSE 'integer' END ELSE 'string' END AS type FROM (SELECT user_id, {_K} AS k FROM events) GROUP BY 1",
    "c21_schema_types": "SELECT n_nationkey, ['object', 'array', 'string', 'number', 'string', 'number', 'null'][n_nationkey % 7 + 1] AS type FROM nation",
    "c19_clamp": f"SELECT event_id, CASE WHEN {_K} < 10 THEN 10 WHEN {_K} >= 90 THEN 89 ELSE {_K} END AS k FROM events",
    "c18_argument_repair": f"""SELECT event_id, '{{"file_path": "f' || {_K} || '", "timeout": ' || least(60, greatest(1, {_K})) || ', "x": 1}}' AS args FROM events""",
    "c29_hash_edits": r"SELECT doc_id, md5('A' || chr(10) || 'B' || CASE WHEN contains(text, chr(10)) THEN chr(10) || 'C' || substring(text, instr(text, chr(10))) ELSE '' END) AS digest FROM documents",
    "c28_c30_diffs": "SELECT doc_id, CAST(1 AS BIGINT) AS removed, CAST(1 AS BIGINT) AS added, CAST(1 AS BIGINT) AS marked FROM documents",
    "c16_sanitized": r"SELECT item_id, md5('No 1! `a  b???` ' || regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '([!?.,;:~])[!?.,;:~]{2,}', '\1', 'g') || ' ?') AS digest FROM benchmark",
    "c17_cased": "SELECT item_id, left('run `Make ALL` in ```' || chr(10) || 'A B' || chr(10) || '``` then ' || lower(text), 100) AS text FROM benchmark",
    "c15_valid_text": "SELECT item_id, md5(repeat('z', 100) || text) AS digest FROM benchmark",
    "c22_program_output": "SELECT item_id, md5(text || '  1  end') AS digest FROM benchmark",
    "c35_c36_event_types": f"""SELECT event_id, CASE k % 3 WHEN 0 THEN 'SubagentEvent' WHEN 2 THEN 'StepBegin' ELSE CASE WHEN k % 2 = 0 THEN 'TextPart' ELSE 'ThinkPart' END END AS type, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 'TextPart' ELSE 'ThinkPart' END END AS inner, CASE WHEN k % 4 = 0 THEN '{{broken' ELSE '{{"k":' || k || '}}' END AS args FROM (SELECT event_id, {_K} AS k FROM events)""",
}

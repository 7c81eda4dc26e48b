"""Textual LLVM IR as tables. A file is read whole by one task; its rows are modules, functions, instructions, structs, metadata.

Parsing lines is the one step that needs Python; everything after it works on the tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from irloom import schemas
from irloom.functions.storage import materialise

_ROW = {
    "module": schemas.MODULES,
    "function": schemas.FUNCTIONS,
    "inst": schemas.INSTRUCTIONS,
    "struct": schemas.STRUCTS,
    "meta": schemas.METADATA,
}
#: Rows of a batch that the parser hands on, of however many modules.
BATCH = 4_096
SCHEMA = "record string, " + ", ".join(f"{k} struct<{', '.join(p.replace(' ', ':', 1) for p in re.split(r', (?![^<]*>)', v))}>" for k, v in _ROW.items())

_NAME = r'(?:"(?P<q>[^"]*)"|(?P<n>[-\w.$]+))'
_FUNC = re.compile(rf"^(?P<what>define|declare)\s+(?P<head>.*?)@{_NAME}\((?P<tail>.*)$")
_LABEL = re.compile(r'^(?:"([^"]+)"|([-\w.$]+)):')
_CALL = re.compile(r'^(?:(?:tail|musttail|notail)\s+)?(?:call|invoke)\s+(?P<type>.*?)\s*(?P<callee>@"[^"]*"|@[-\w.$]+|%"[^"]*"|%[-\w.$]+)\((?P<rest>.*)$')
_RESULT = re.compile(r'^(%(?:"[^"]*"|[-\w.$]+))\s*=\s*(.*)$')
_TARGET = re.compile(r'label\s+%(?:"([^"]+)"|([-\w.$]+))')
_PARAM = re.compile(r'\s(%(?:"[^"]*"|[-\w.$]+))$')
_LINKAGES = {"private", "internal", "available_externally", "linkonce", "weak", "common", "appending", "extern_weak", "linkonce_odr", "weak_odr", "external"}
_ATTRS = re.compile(
    r"\b(?:noundef|nonnull|noalias|nocapture|readonly|readnone|writeonly|signext|zeroext|inreg|returned|immarg|dso_local|local_unnamed_addr|unnamed_addr|fastcc|ccc|coldcc|"
    r"tailcc|swiftcc|inbounds|nuw|nsw|exact|volatile|atomic|hidden|protected|noreturn|nounwind)\b|\b(?:align|dereferenceable|dereferenceable_or_null|captures|sret|byval|range)\s*\([^)]*\)|\balign \d+"
)


def _split(text: str) -> list[str]:
    """Parts between commas outside brackets."""
    out, depth, start, quoted = [], 0, 0, False
    for i, ch in enumerate(text):
        if ch == '"':
            quoted = not quoted
        elif not quoted:
            if ch in "([{<":
                depth += 1
            elif ch in ")]}>":
                depth -= 1
            elif ch == "," and not depth:
                out.append(text[start:i].strip())
                start = i + 1
    last = text[start:].strip()
    return [*out, last] if last else out


def _inside(text: str) -> tuple[str, str]:
    """What stands before the bracket that closes an open one, and what follows it."""
    depth, quoted = 1, False
    for i, ch in enumerate(text):
        if ch == '"':
            quoted = not quoted
        elif not quoted:
            depth += (ch == "(") - (ch == ")")
            if not depth:
                return text[:i], text[i + 1 :]
    return text, ""


def _operand(idx: int, text: str) -> dict:
    text = " ".join(_ATTRS.sub(" ", text).split())
    kind, _, value = text.rpartition(" ")
    number = int(value) if re.fullmatch(r"-?\d+", value) else None
    plain = value.replace('"', "")
    return {"idx": idx, "value": plain, "type": kind, "is_const": number is not None or value in ("null", "true", "false", "undef", "zeroinitializer"), "is_null": value == "null", "is_global": value.startswith("@"), "int_value": number}


def _types(text: str) -> list[str]:
    return [" ".join(_ATTRS.sub(" ", p).split()).split(" %")[0].split(" @")[0] for p in _split(text) if p != "..."]


@dataclass
class _Function:
    name: str
    bb: int = -1
    block: str = "entry"
    ordinal: int = 0


def parse(module_id: str, text: str) -> Iterator[tuple[str, dict]]:
    """(record, row) of a module's text."""
    module = {"module_id": module_id, "source_filename": None, "triple": None, "datalayout": None, "producer": None}
    now: _Function | None = None
    for line in text.splitlines():
        line = line.strip()
        if not line or line[0] == ";":
            continue
        if now is None:
            if m := re.match(r'^source_filename\s*=\s*"(.*)"', line):
                module["source_filename"] = m[1]
            elif m := re.match(r'^target (triple|datalayout)\s*=\s*"(.*)"', line):
                module[m[1]] = m[2]
            elif m := re.match(r'^%(?:"([^"]*)"|([-\w.$]+))\s*=\s*type\s+(<?)\{(.*?)\}', line):
                yield "struct", {"module_id": module_id, "name": m[1] or m[2], "fields": _split(m[4]), "packed": bool(m[3])}
            elif m := re.match(r"^(!\d+)\s*=\s*(?:distinct\s+)?!(DI\w+)\((.*)\)", line):
                get = lambda k: (re.search(rf'\b{k}:\s*"?([^",)]*)', m[3]) or [None, None])[1]  # noqa: B023, E731
                if m[2] == "DICompileUnit" and get("producer"):
                    module["producer"] = get("producer")
                number = get("line")
                yield "meta", {"module_id": module_id, "id": m[1], "kind": m[2], "line": int(number) if number and number.isdigit() else None, "file": get("filename") or get("file"), "name": get("name"), "scope": get("scope")}
            elif m := _FUNC.match(line):
                params, tail = _inside(m["tail"])
                head = m["head"].split()
                linkage = next((w for w in head if w in _LINKAGES), "external")
                ret = " ".join(w for w in _ATTRS.sub(" ", m["head"]).split() if w not in _LINKAGES and not w.startswith("#"))
                name = m["q"] if m["q"] is not None else m["n"]
                kinds = _types(params)
                given = [p for p in _split(params) if p != "..."]
                named = [at[1].replace('"', "") if (at := _PARAM.search(p)) else f"%{i}" for i, p in enumerate(given)]
                person = re.search(r'personality\s+.*?@(?:"([^"]*)"|([-\w.$]+))', tail)
                dbg = re.search(r"!dbg\s+(!\d+)", tail)
                yield "function", {"module_id": module_id, "func": name, "is_declaration": m["what"] == "declare", "linkage": linkage, "ret_type": ret, "param_types": kinds, "n_params": len(kinds), "variadic": "..." in params, "personality": (person[1] or person[2]) if person else None, "subprogram": dbg[1] if dbg else None, "line": None, "params": named, "readonly": [bool(re.search(r"\breadonly\b", p)) for p in given]}
                if m["what"] == "define":
                    now = _Function(name)
            continue
        if line == "}":
            now = None
            continue
        if m := _LABEL.match(line):
            now.bb += 1
            now.block = m[1] or m[2]
            continue
        if now.bb < 0:
            now.bb = 0
        dbg = re.search(r"!dbg\s+(!\d+)", line)
        body = re.sub(r",\s*!.*$", "", re.sub(r"\s*;.*$", "", line))
        result = None
        if m := _RESULT.match(body):
            result, body = m[1].replace('"', ""), m[2]
        row = {"module_id": module_id, "func": now.name, "bb": now.bb, "ordinal": now.ordinal, "result": result, "opcode": body.split(" ", 1)[0], "type": None, "callee": None, "operands": [], "pred": None, "labels": [a or b for a, b in _TARGET.findall(body)], "dbg": dbg[1] if dbg else None, "block": now.block}
        if m := _CALL.match(body):
            args, _ = _inside(m["rest"])
            row["opcode"] = "invoke" if body.startswith("invoke") else "call"
            row["callee"] = m["callee"].replace('"', "").removeprefix("@")
            row["type"] = " ".join(_ATTRS.sub(" ", m["type"]).split())
            row["operands"] = [_operand(i, a) for i, a in enumerate(_split(args))]
        else:
            rest = body.split(" ", 1)[1] if " " in body else ""
            rest = " ".join(_ATTRS.sub(" ", rest).split())
            op = row["opcode"]
            if op == "icmp" and " " in rest:
                row["pred"], rest = rest.split(" ", 1)
            if op == "phi":
                row["type"] = rest.split(" ", 1)[0]
                pairs = re.findall(r"\[\s*([^,\]]+),\s*%([-\w.$\"]+)\s*\]", rest)
                row["operands"] = [_operand(i, f"{row['type']} {v}") for i, (v, _) in enumerate(pairs)]
                row["labels"] = [b.replace('"', "") for _, b in pairs]
            elif op in ("br", "switch"):
                row["operands"] = [_operand(0, p) for p in _split(rest)[:1] if not p.startswith("label")]
            elif op in ("getelementptr", "load", "alloca"):
                parts = _split(rest)
                row["type"] = parts[0] if parts else None
                row["operands"] = [_operand(i, p) for i, p in enumerate(parts[1:])]
            elif op not in ("unreachable", "fence"):
                parts = [p for p in _split(re.sub(r"\s+to\s+\S+$", "", rest)) if not p.startswith("label")]
                row["operands"] = [_operand(i, p) for i, p in enumerate(parts)]
                first = row["operands"][0]["type"] if row["operands"] else None
                row["type"] = first
                for o in row["operands"]:
                    o["type"] = o["type"] or first
        yield "inst", row
        now.ordinal += 1
    yield "module", module


@dataclass
class Module:
    """The tables of a set of modules, and what has been derived from them (kept by name, in shared storage)."""

    modules: DataFrame
    functions: DataFrame
    instructions: DataFrame
    structs: DataFrame
    metadata: DataFrame
    kept: dict[str, DataFrame] = field(default_factory=dict)


def from_texts(texts: DataFrame) -> Module:
    """Tables of texts (module_id, text). Parsed once, in storage with a folder for each kind of record: a table reads its own."""

    kinds = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (x for batch in batches for module_id, text in zip(batch.column("module_id").to_pylist(), batch.column("text").to_pylist()) for x in parse(module_id, text or ""))
        while lot := list(islice(rows, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in lot]), *[pa.array([d if r == k else None for r, d in lot], kinds.field(k).type) for k in _ROW]], kinds.names)

    parsed = materialise(texts.select("module_id", "text").mapInArrow(run, SCHEMA), "ir", ["record"])
    get = lambda k: parsed.where(F.col("record") == k).select(f"{k}.*")
    return Module(get("module"), get("function"), get("inst"), get("struct"), get("meta"))


def load(spark: SparkSession, path: str) -> Module:
    """Tables of the files at a path or pattern; a file's path is its module."""
    return from_texts(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("module_id"), F.col("value").alias("text")))

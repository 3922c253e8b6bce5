"""Small files read on their own: prices, facts, symbol indexes, transcripts that grow."""

from __future__ import annotations

import datetime
import json
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of rates in a price file; the highest price of a million tokens and the highest factor of a region.
_RATES = ("input", "cache_write_5m", "cache_write_1h", "cache_read", "output")
_MODEL = {"standard", "fast", "long_prompt", "long_prompt_above_tokens", "us_only"}
MOST_DOLLARS, MOST_FACTOR = 10_000.0, 10.0
FACT_FIELDS = ("fact_id", "claim", "status")
_RATE = "struct<input:bigint,write_5m:bigint,write_1h:bigint,read:bigint,output:bigint>"


class BadFile(ValueError):
    """A file that is not what it should be; none of it is used."""


def _rates(model: str, name: str, given: dict) -> tuple[int, ...]:
    if set(given) != set(_RATES):
        raise BadFile(f"{model}.{name} must give {', '.join(_RATES)}")
    out = []
    for k in _RATES:
        dollars = given[k]
        pico = round(float(dollars) * 1_000_000) if isinstance(dollars, int | float) and not isinstance(dollars, bool) else -1
        if not 0 <= pico <= MOST_DOLLARS * 1_000_000 or (dollars > 0 and pico == 0):
            raise BadFile(f"{model}.{name}.{k} is not a price")
        out.append(pico)
    return tuple(out)


def parse_prices(text: str) -> list[tuple]:
    """Rows (model, standard, fast, long, above, us_per_mille) of a price file in dollars a million tokens; strict: an unknown field or half a pair refuses all."""
    try:
        file = tomllib.loads(text)
        datetime.date.fromisoformat(file["updated"])
    except (tomllib.TOMLDecodeError, KeyError, TypeError, ValueError) as e:
        raise BadFile(str(e)) from e
    if set(file) - {"updated", "source", "models"} or not isinstance(file.get("models"), dict):
        raise BadFile("a price file has updated, source and models")
    rows = []
    for model, m in file["models"].items():
        if set(m) - _MODEL or "standard" not in m or ("long_prompt" in m) != ("long_prompt_above_tokens" in m):
            raise BadFile(f"{model}: unknown, missing or unpaired fields")
        factor = m.get("us_only")
        if factor is not None and not (0 < float(factor) <= MOST_FACTOR and round(float(factor) * 1000)):
            raise BadFile(f"{model}.us_only is not a factor")
        rows.append((model, *(_rates(model, k, m[k]) if k in m else None for k in ("standard", "fast", "long_prompt")), m.get("long_prompt_above_tokens"), None if factor is None else round(float(factor) * 1000)))
    return rows


def prices(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame(parse_prices(text), f"model string, standard {_RATE}, fast {_RATE}, long {_RATE}, above long, us_per_mille int")


def parse_facts(text: str) -> list[tuple]:
    """Facts of a shared file `{"version": 1, "facts": [...]}`; strict as prices are."""
    try:
        file = json.loads(text)
    except json.JSONDecodeError as e:
        raise BadFile(str(e)) from e
    if not isinstance(file, dict) or set(file) != {"version", "facts"} or file["version"] != 1:
        raise BadFile("a facts file has version 1 and facts")
    for f in file["facts"]:
        if not isinstance(f, dict) or set(f) != set(FACT_FIELDS):
            raise BadFile("a fact has " + ", ".join(FACT_FIELDS))
    return [tuple(f[k] for k in FACT_FIELDS) for f in file["facts"]]


def facts_text(rows: list[tuple]) -> str:
    """The same facts give the same text."""
    return json.dumps({"version": 1, "facts": [dict(zip(FACT_FIELDS, r, strict=True)) for r in sorted(rows)]}, ensure_ascii=False, indent=1, sort_keys=True)


# ---------------------------------------------------------------- symbol indexes
def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protobuf message; what can't be read ends it."""
    at, n = 0, len(data)

    def varint() -> int:
        nonlocal at
        out, shift = 0, 0
        while at < n:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7
        raise BadFile("a number ends too early")

    while at < n:
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        elif key & 7 in (1, 5):
            at += 8 if key & 7 == 1 else 4
        else:
            raise BadFile("an unknown kind of field")


def _packed(data: bytes) -> list[int]:
    out, shift, value = [], 0, 0
    for b in data:
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            out.append(value)
            shift, value = 0, 0
    return out


def parse_scip(data: bytes, most: int = 1_000_000) -> list[tuple[str, str, int, bool]]:
    """(path, symbol, line, is_definition) of the occurrences of a symbol index: documents are its field 2, with path 1 and occurrences 2, which have a range 1, a symbol 2 and roles 3. A file of more than `most` is refused whole."""
    rows: list[tuple[str, str, int, bool]] = []
    for number, doc in _fields(data):
        if number != 2:
            continue
        path, found = "", []
        for k, v in _fields(doc):
            if k == 1:
                path = v.decode()
            elif k == 2:
                line, symbol, roles = -1, "", 0
                for i, x in _fields(v):
                    if i == 1:
                        line = _packed(x)[0] if isinstance(x, bytes) and x else x if isinstance(x, int) else -1
                    elif i == 2:
                        symbol = x.decode()
                    elif i == 3:
                        roles = x
                if symbol and line >= 0 and not symbol.startswith("local "):
                    found.append((symbol, line + 1, bool(roles & 1)))
        rows += [(path, *f) for f in found]
        if len(rows) > most:
            raise BadFile("the index has more occurrences than are read")
    return rows


def scip_occurrences(files: DataFrame, content: str = "content") -> DataFrame:
    """(path, symbol, line, is_definition) of binary index files, each read where it is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for x in b[content] for r in parse_scip(bytes(x))], columns=["path", "symbol", "line", "is_definition"])

    return files.select(content).mapInPandas(run, "path string, symbol string, line long, is_definition boolean")


# ---------------------------------------------------------------- transcripts that grow
def tailed(texts: DataFrame, offsets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, offsets): whole lines behind each file's offset, and where the next reading goes on.

    texts(file, content: bytes), offsets(file, at). A line counts once its end is there; a file that has become shorter than
    its offset was written anew and is read from its beginning.
    """
    j = texts.join(offsets, "file", "left").withColumn("at", F.when(F.octet_length("content") >= F.coalesce("at", F.lit(0)), F.coalesce("at", F.lit(0))).otherwise(0))
    fresh = j.select("file", "at", F.substr("content", (F.col("at") + 1).cast("int")).alias("fresh"))
    text = F.decode("fresh", "UTF-8")
    whole = F.when(text.contains("\n"), F.regexp_extract(text, r"(?s)^(.*\n)", 1)).otherwise("")
    read = fresh.select("file", "at", whole.alias("whole"))
    lines = read.select("file", F.posexplode(F.filter(F.split("whole", "\n"), lambda x: x != "")).alias("pos", "line"))
    return lines, read.select("file", (F.col("at") + F.octet_length("whole")).alias("at"))

"""A report against its schema: every departure with the JSON path where it stands.

A report is one row: a JSON text, a variant, or a struct, whose schema tells the kinds of its parts so
that no text need be written and read. The rules follow the report's own shape, so all of them are
checked in one pass inside the row; nothing is shuffled. A check names the type it wants, and those of
fields and lists are put together, so that one reading of a variant takes the whole report apart and
no text is copied from level to level. What is of another kind is null there.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, FractionalType, IntegralType, MapType, NullType, NumericType, StringType, StructField, StructType, VariantType

from quire import fixed

# Fixed value: a link to a place in the reference.
HREF = r"^/reference/[a-z0-9/-]+#[A-Za-z0-9._:-]+$"
_NONE = "cast(array() as array<string>)"
_NUMERIC = "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"


class Check(NamedTuple):
    """The problems of a value at a place, by its type; a variant is read as ``kind`` first."""

    problems: Callable[[Column, Column, DataType], Column]
    kind: DataType = VariantType()

    def at(self, v: Column, where: Column, t: DataType) -> Column:
        if isinstance(t, VariantType) and not isinstance(self.kind, VariantType):
            return _let(F.try_variant_get(v, "$", self.kind.simpleString()), lambda x: self.problems(x, where, self.kind))
        return self.problems(v, where, t)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_KINDS = ((StringType, "STRING"), (BooleanType, "BOOLEAN"), (IntegralType, "BIGINT"), (FractionalType, "DOUBLE"), (ArrayType, "ARRAY"), ((StructType, MapType), "OBJECT"))


def _kind(v: Column, t: DataType) -> Column:
    """STRING, BIGINT, OBJECT<…>, …; VOID for null and for what is not there. In a variant it walks all that lies below."""
    if isinstance(t, VariantType):
        return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    return F.when(v.isNull(), "VOID").otherwise(next((name for types, name in _KINDS if isinstance(t, types)), "OTHER"))


def _as(v: Column, t: DataType, kind: type[DataType], name: str) -> Column:
    """A scalar of that kind; null for others, but a variant's number or truth value is told as text too."""
    if isinstance(t, VariantType):
        return F.try_variant_get(v, "$", name)
    return v.cast(name) if isinstance(t, kind) else F.lit(None).cast(name)


def _text(v: Column, t: DataType) -> Column:
    return _as(v, t, StringType, "string")


def _number(v: Column, t: DataType) -> Column:
    return _as(v, t, NumericType, "double")


def _field(v: Column, t: DataType, key: str) -> tuple[Column, DataType]:
    """A named field and its type; what has no such field has a null."""
    if isinstance(t, StructType) and key in t.names:
        return v[key], t[key].dataType
    if isinstance(t, MapType):
        return v[key], t.valueType
    if isinstance(t, VariantType):
        return F.try_variant_get(v, f"$.{key}", "variant"), t
    return F.lit(None), NullType()


def _is_list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>").isNotNull()


def _said(broken: Column, where: Column, problem: str) -> Column:
    return F.when(broken, F.array(F.concat(where, F.lit(f": {problem}")))).otherwise(F.expr(_NONE))


def _under(where: Column, key: str) -> Column:
    return F.concat(where, F.lit(f".{key}"))


def words(most: int, optional: bool = False) -> Check:
    """Text of at most so many characters."""
    def check(v, where, t):
        kind, text = _kind(v, t), _text(v, t)
        long = F.char_length(text) > most
        bad = (kind != "STRING") | (long if isinstance(t, VariantType) else (F.octet_length(text) > most) & long)  # bytes need no counting
        return _said((kind != "VOID") & bad if optional else bad, where, f"expected text of at most {most} characters")

    return Check(check)


@Check
def status(v: Column, where: Column, t: DataType) -> Column:
    return _said((_kind(v, t) != "STRING") | ~_text(v, t).isin(fixed.STATUSES), where, "unknown status")


@Check
def whole(v: Column, where: Column, t: DataType) -> Column:
    number = _number(v, t)
    numeric = _kind(v, t).rlike(_NUMERIC)
    return _said(~(numeric & (number == F.floor(number)) & (number >= 0)), where, "expected a whole number")


@Check
def link(v: Column, where: Column, t: DataType) -> Column:
    bad = (_kind(v, t) != "STRING") | ~_text(v, t).rlike(HREF)
    return _said((_kind(v, t) != "VOID") & bad, where, "not a reference link")


def items(most: int, each: Check, optional: bool = False) -> Check:
    """A list of at most so many, each checked; one that is too long is not looked into."""
    def check(found, where, t):
        too_long = F.array(F.concat(where, F.lit(f": expected a list of at most {most}")))
        if not isinstance(t, ArrayType):
            return too_long
        inner = F.flatten(F.transform(found, lambda x, i: each.at(x, F.concat(where, F.lit("["), i.cast("string"), F.lit("]")), t.elementType)))
        return F.when(found.isNotNull() & (F.size(found) <= most), inner).otherwise(too_long)

    there = Check(check, ArrayType(each.kind))
    return Check(lambda v, where, t: F.when(_kind(v, t) == "VOID", F.expr(_NONE)).otherwise(there.at(v, where, t))) if optional else there


def _each(checks: dict[str, Check], v: Column, t: DataType, where: Callable[[str], Column]) -> Column:
    found = {key: _field(v, t, key) for key in checks}
    return F.concat(*[check.at(found[key][0], where(key), found[key][1]) for key, check in checks.items()])


def _fields_kind(checks: dict[str, Check]) -> DataType:
    return StructType([StructField(key, check.kind) for key, check in checks.items()])


def fields(**checks: Check) -> Check:
    """Named fields, in order. What has no fields lacks them all."""
    return Check(lambda v, where, t: _each(checks, v, t, lambda key: _under(where, key)), _fields_kind(checks))


def _object(check: Check, problem: str) -> Check:
    """Something with fields or elements, then checked; a list lacks all fields."""
    def found(v, where, t):
        none = F.array(F.concat(where, F.lit(f": {problem}")))
        if isinstance(t, VariantType):
            return _let(F.try_variant_get(v, "$", check.kind.simpleString()), lambda x: F.when(x.isNotNull() | _is_list(v), check.problems(x, where, check.kind)).otherwise(none))
        return F.when(v.isNotNull(), check.problems(v, where, t)).otherwise(none) if isinstance(t, (StructType, MapType, ArrayType)) else none

    return Check(found)


# The fields of a report, their order and limits.
CITATION = fields(label=words(200), href=link)
INSTANCE = fields(label=words(400), status=status)
EVIDENCE = _object(fields(quote=words(1500), locator=words(500)), "not an object")
ITEM = fields(
    id=words(12), title=words(300), status=status, finding=words(4000), action=words(2000, True), requirement=words(2000), evidence=items(20, EVIDENCE),
    gaps=items(20, words(1000)), citations=items(10, CITATION), instances=items(120, INSTANCE, True))
SECTION = fields(id=words(40), title=words(200), letter=words(2), items=items(40, ITEM))
_ENTRY = dict(id=words(12), title=words(300), status=status, shows=words(4000), evidence=items(20, EVIDENCE), gaps=items(20, words(1000)), action=words(2000, True))
PART = fields(heading=words(300), entries=items(20, fields(**_ENTRY)))
STATEMENTS = fields(
    compliance=fields(title=words(200), parts=items(8, PART)),
    soundness=fields(title=words(200), entries=items(10, fields(**_ENTRY, questions=items(6, words(600))))))


@Check
def _document_type(v: Column, where: Column, t: DataType) -> Column:
    return _said((_kind(v, t) != "STRING") | ~_text(v, t).isin(fixed.DOCUMENT_TYPES), where, "unknown")


DOCUMENT = fields(name=words(200), type=_document_type, bytes=whole, characters=whole, words=whole)


def report_problems(report: Column, schema: str, version: int, t: DataType = VariantType()) -> Column:
    """array<string> of "path: problem" for a report as a variant, or of type ``t``; null is no object. ``schema`` and ``version`` are those it must name."""
    def named(v, where, t):
        return _said((_kind(v, t) != "STRING") | (F.coalesce(_text(v, t), F.lit("")) != schema), where, "not a plan check report")

    def numbered(v, where, t):
        numeric = _kind(v, t).rlike(_NUMERIC)
        return _said(~numeric | F.coalesce(_number(v, t) != version, F.lit(True)), where, f"expected {version}")

    def summed(v, where, t):
        counts, inner = _field(v, t, "counts")
        kind = _kind(counts, inner)
        none = (kind == "VOID") | ((kind == "BOOLEAN") & ~_as(counts, inner, BooleanType, "boolean")) | (
            (kind == "STRING") & (_text(counts, inner) == "")) | (F.coalesce(_number(counts, inner), F.lit(1.0)) == 0)
        return _said(~_kind(v, t).rlike("^(OBJECT|ARRAY)") | none, where, "missing")

    top = dict(
        schema=Check(named), version=Check(numbered), generatedAt=words(40), notice=words(2000), document=_object(DOCUMENT, "missing"),
        sections=items(12, SECTION), statements=_object(STATEMENTS, "missing"), summary=Check(summed))
    no_object = F.array(F.lit("the report is not an object"))

    def found(x, where, t):
        return F.when(x.isNotNull(), _each(top, x, t, F.lit)).otherwise(no_object) if isinstance(t, (StructType, MapType)) else no_object

    return Check(found, _fields_kind(top)).at(report, F.lit(""), t)


def problems_of(reports: DataFrame, key: str, json: str, schema: str = fixed.REPORT_SCHEMA, version: int = fixed.REPORT_VERSION) -> DataFrame:
    """(key, path, problem): a row for each departure of the JSON text; what is no JSON is no object. A sound report has no row."""
    return problems_in(reports.select(key, F.try_parse_json(json).alias("_r")), key, "_r", schema, version)


def problems_in(reports: DataFrame, key: str, report: str, schema: str = fixed.REPORT_SCHEMA, version: int = fixed.REPORT_VERSION) -> DataFrame:
    """``problems_of`` for reports that are variants or structs."""
    found = reports.select(key, F.explode(report_problems(F.col(report), schema, version, reports.schema[report].dataType)).alias("said"))
    path = F.when(F.col("said").contains(": "), F.split_part("said", F.lit(": "), F.lit(1))).otherwise("")
    return found.select(key, path.alias("path"), F.when(path == "", F.col("said")).otherwise(F.split_part("said", F.lit(": "), F.lit(2))).alias("problem"))

"""Records out of a model's JSON answers: coercion, back-fill, grounding in the source, and the route between attempts.

The model itself is a provider: any function from a column of prompts to a column of answers. Without one every answer is null and
the route falls through to the rules.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.functions.text import blank, grounded, json_object, strip
from talweg.functions.vectors import bound

Provider = Callable[[Column], Column]


def no_provider(prompt: Column) -> Column:
    """The provider that is there when none is configured."""
    return F.lit(None).cast("string")


# Other names under which models return a field.
BASIC_NAMES = {
    "name": ("name", "full_name", "candidate_name", "姓名"), "phone": ("phone", "mobile", "tel"), "email": ("email", "mail"), "location": ("location", "city", "address"),
    "birth_text": ("birth_text", "birth", "birthday"), "target_role": ("target_role", "summary", "objective", "求职意向"),
}
EDUCATION_NAMES = {
    "school": ("school", "school_name", "university"), "degree": ("degree",), "major": ("major", "field_of_study", "专业"), "start": ("start", "start_date", "from"), "end": ("end", "end_date", "to"), "raw_block": ("raw_block",),
}
WORK_NAMES = {
    "company": ("company", "employer", "organization"), "job_role": ("job_role", "title", "position", "job_title", "role"), "job_type": ("job_type", "type"), "start": ("start", "start_date", "from"), "end": ("end", "end_date", "to"),
    "raw_block": ("raw_block",),
}
PROJECT_NAMES = {
    "project_name": ("project_name", "name", "title", "project"), "role": ("role",), "start": ("start", "start_date"), "end": ("end", "end_date"), "raw_block": ("raw_block",),
}
ITEM_NAMES = ("descriptions", "bullets", "responsibilities", "highlights", "description")
JOB_TYPES = ("internship", "fulltime", "parttime")
WORK_LABELS = ("工作内容", "主要职责", "职责", "负责", "业绩", "成果", "描述", "工作描述", "responsibilities")
PROJECT_LABELS = ("项目描述", "工作内容", "项目成果", "职责", "负责", "描述", "成果", "details", "description")
SKILL_LABELS = ("技术栈", "技术", "技能", "skills", "skill")


_SKILL_NAMES = ("skills", "skill")
_ADDITIONAL_NAMES = {"languages": ("languages",), "certificates": ("certificates", "certifications"), "awards": ("awards",), "self_evaluation": ("self_evaluation", "self_intro"), "raw_block": ("raw_block",)}


def _fields(*groups: Sequence[str]) -> str:
    return ",".join(f"`{n}`:string" for n in dict.fromkeys(n for g in groups for n in g))


def _schema() -> str:
    """Every name a model may use, as text: lists and objects inside come as their JSON."""
    basic = _fields(*BASIC_NAMES.values(), ("links", "raw_block"))
    extra = _fields(*_ADDITIONAL_NAMES.values(), _SKILL_NAMES)
    return f"basic struct<{basic}>, education array<string>, work_experience array<string>, projects array<string>, skills string, additional struct<{extra}>"


def _field(node: Column, names: Sequence[str]) -> Column:
    return F.coalesce(*[F.when(~blank(node[n]), strip(node[n])) for n in names], F.lit(""))


def _rows(node: Column, name: str, names: dict[str, tuple[str, ...]]) -> Column:
    """The objects of a list, each read by itself so that one of another kind costs no other."""
    fields = f"struct<{_fields(*names.values(), ITEM_NAMES)}>"
    objects = F.filter(F.coalesce(node[name], F.array().cast("array<string>")), lambda x: x.isNotNull() & x.startswith("{"))
    return F.filter(F.transform(objects, lambda x: F.from_json(x, fields)), lambda x: x.isNotNull())


def _texts(raw: Column) -> Column:
    """Items of a list given as JSON text; a plain text is a list of one; null if there are none."""
    items = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(~blank(raw), F.array(raw))
    kept = F.filter(F.transform(items, lambda x: strip(x)), lambda x: x.isNotNull() & (x != ""))
    return bound(kept, lambda k: F.when(F.size(k) > 0, k))


def _list(node: Column, names: Sequence[str]) -> Column:
    return F.coalesce(*[_texts(node[n]) for n in names], F.array().cast("array<string>"))


def _record(node: Column, names: dict[str, tuple[str, ...]], *more: Column) -> Column:
    return F.struct(*[_field(node, alternatives).alias(f) for f, alternatives in names.items()], *more)


def job_type(given: Column, *evidence: Column) -> Column:
    """A known type; else internship if the evidence says so, else unknown."""
    known = F.lower(strip(given))
    return F.when(known.isin(*JOB_TYPES), known).when(F.lower(F.concat_ws(" ", *evidence)).rlike("实习|intern"), "internship").otherwise("unknown")


def narrative(block: Column, skip: Sequence[Column], most: int) -> Column:
    """Lines of a block that tell something: long enough, no bare title, date or list of technologies."""
    lines = F.array_distinct(F.transform(F.split(F.coalesce(block, F.lit("")), r"\r?\n"), lambda x: strip(x)))
    telling = F.filter(lines, lambda x: (F.length(x) >= 12) & ~x.rlike(r"^\d{4}[.\-/]\d{1,2}") & ~x.contains("技术栈") & ~F.lower(x).rlike("^(技术|skills?)[:：]") & ~F.array_contains(F.array(*skip), x))
    return F.slice(telling, 1, most)


def labelled(block: Column, labels: Sequence[str]) -> Column:
    """What follows a label and a colon at the start of a line."""
    pattern = rf"^(?:{'|'.join(labels)})[^:：]{{0,20}}[:：]\s*(.+)$"
    lines = F.transform(F.split(F.coalesce(block, F.lit("")), r"\r?\n"), lambda x: strip(x))
    return F.array_distinct(F.transform(F.filter(lines, lambda x: F.lower(x).rlike(pattern)), lambda x: strip(F.regexp_extract(x, "(?i)" + pattern, 1))))


def _filled(given: Column, block: Column, labels: Sequence[str], skip: Sequence[Column], most: int) -> Column:
    named = bound(labelled(block, labels), lambda x: F.when(F.size(x) > 0, x))
    return F.when(F.size(given) > 0, given).otherwise(F.coalesce(named, narrative(block, skip, most)))


def layer1_of_answer(answer: Column) -> Column:
    """The layer-1 record in an answer, whatever names the model used; null if there is no JSON object in it."""
    def work(row: Column) -> Column:
        def finish(r: Column) -> Column:
            items = _filled(_list(row, ITEM_NAMES), r["raw_block"], WORK_LABELS, [r["company"], r["job_role"]], 6)
            return r.withField("job_type", job_type(r["job_type"], r["job_role"], r["company"], r["raw_block"])).withField("descriptions", items)

        return bound(_record(row, WORK_NAMES), finish)

    def project(row: Column) -> Column:
        return bound(_record(row, PROJECT_NAMES), lambda r: r.withField("descriptions", _filled(_list(row, ITEM_NAMES), r["raw_block"], PROJECT_LABELS, [r["project_name"]], 5)))

    def whole(node: Column) -> Column:
        basic, extra = node["basic"], node["additional"]
        rows = F.struct(F.transform(_rows(node, "work_experience", WORK_NAMES), work).alias("w"), F.transform(_rows(node, "projects", PROJECT_NAMES), project).alias("p"))

        def assembled(r: Column) -> Column:
            blocks = F.concat(F.array(_field(extra, ("raw_block",))), r["p"]["raw_block"], r["w"]["raw_block"])
            named = F.flatten(F.transform(blocks, lambda b: F.flatten(F.transform(labelled(b, SKILL_LABELS), lambda s: F.split(s, "[、,，;/；|]+")))))
            skills = F.filter(F.transform(F.concat(F.coalesce(_texts(node["skills"]), F.array().cast("array<string>")), _list(extra, _SKILL_NAMES), named), lambda s: strip(s)), lambda s: s != "")
            education = F.transform(_rows(node, "education", EDUCATION_NAMES), lambda row: _record(row, EDUCATION_NAMES))
            additional = F.struct(*[(_list if n in ("languages", "certificates", "awards") else _field)(extra, names).alias(n) for n, names in _ADDITIONAL_NAMES.items()])
            return F.struct(
                _record(basic, BASIC_NAMES, _list(basic, ("links",)).alias("links"), _field(basic, ("raw_block",)).alias("raw_block")).alias("basic"), education.alias("education"),
                r["w"].alias("work_experience"), r["p"].alias("projects"), F.array_distinct(skills).alias("skills"), additional.alias("additional"))

        return bound(rows, assembled)

    node = F.from_json(json_object(answer), _schema())
    return bound(node, lambda n: F.when(n.isNotNull(), whole(n)))


def shape_error(answer: Column, required: Sequence[str] = ("basic",)) -> Column:
    """What is wrong with an answer: null if it is an object with the required keys."""
    node = json_object(answer)
    missing = F.array_compact(F.array(*[F.when(F.get_json_object(node, f"$.{k}").isNull(), F.lit(k)) for k in required]))
    return F.when(node.isNull(), "no_json_object").when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))


def keep_grounded(layer1: Column, source: Column) -> Column:
    """Drops entries and items that do not stand in the source (likely invented); an empty source drops them all."""
    def stands(c: Column, least: int) -> Column:
        return (F.length(strip(c)) > least) & grounded(strip(c), source)

    def items(e: Column) -> Column:
        return F.filter(e["descriptions"], lambda d: grounded(d, source, relaxed=True))

    work = F.filter(layer1["work_experience"], lambda e: stands(e["company"], 1) | stands(e["job_role"], 1) | stands(e["raw_block"], 3))
    projects = F.filter(layer1["projects"], lambda e: stands(e["project_name"], 1) | stands(e["raw_block"], 3))
    with_items = lambda rows: F.transform(rows, lambda e: e.withField("descriptions", items(e)))
    kept = layer1.withField("work_experience", with_items(work)).withField("projects", with_items(projects))
    return kept.withField("skills", F.filter(layer1["skills"], lambda s: grounded(s, source)))


def readable(source: Column, flagged: Column | None = None) -> Column:
    """False for texts too short to hold a résumé, and for short or flagged ones without ideographs."""
    bad = F.lit(False) if flagged is None else F.coalesce(flagged, F.lit(False))
    han = source.rlike(r"[\x{4e00}-\x{9fff}]")
    return (F.length(strip(F.coalesce(source, F.lit("")))) >= 80) & (han | ~bad)


def routed(df: DataFrame, attempts: Sequence[tuple[str, Column]]) -> DataFrame:
    """``df`` with layer1 and route: the first attempt that gave a record."""
    record = F.coalesce(*[c for _, c in attempts])
    route = F.coalesce(*[F.when(c.isNotNull(), F.lit(name)) for name, c in attempts], F.lit("none"))
    return df.withColumn("layer1", record).withColumn("route", route)

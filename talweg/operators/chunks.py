"""Jobs and candidates as text chunks, one row each, and the plan for embedding only what changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.functions.text import blank, clean_list, content_hash, strip

SEPARATOR = " | "
SEMANTIC_CHARS = 2000


def _line(label: str, c: Column) -> Column:
    return F.when(~blank(c), F.concat(F.lit(label), strip(c)))


def _listed(label: str, items: Column, between: str = ", ") -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(label), F.array_join(items, between)))


def packed(items: Column, limit: int = 4000) -> Column:
    """Array of texts: items joined by " | " as long as they stay within ``limit``; an item over it stays whole."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def add(acc: Column, item: Column) -> Column:
        fits = F.length(acc["open"]) + len(SEPARATOR) + F.length(item) <= limit
        return (
            F.when(acc["open"].isNull(), F.struct(acc["done"].alias("done"), item.alias("open")))
            .when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit(SEPARATOR), item).alias("open")))
            .otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), item.alias("open")))
        )

    return F.aggregate(items, start, add, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def _chunk(kind: Column, block: str, text: Column) -> Column:
    return F.struct(kind.alias("profile_type"), F.lit(block).alias("block"), text.alias("chunk_text"))


def _filled(chunks: Column) -> Column:
    return F.filter(chunks, lambda c: ~blank(c["chunk_text"]))


def _rows(df: DataFrame, entity: str, chunks: Column) -> DataFrame:
    rows = df.select(F.lit(entity).alias("entity_type"), F.col("id").alias("entity_id"), F.explode(chunks).alias("c"))
    return rows.select("entity_type", "entity_id", "c.profile_type", "c.block", "c.chunk_text", content_hash(F.col("c.chunk_text")).alias("content_hash"))


def job_chunk_list(limit: int = 4000) -> Column:
    """A job's chunks: skill, resp or resp_i, role, and jd_raw where it has no duties, no title and nothing else about its role."""
    s = F.col("structured")
    skills = F.concat_ws("\n", _listed("必备技能: ", clean_list(s["required_skills"])), _listed("加分技能: ", clean_list(s["preferred_skills"])))
    duties = clean_list(s["responsibilities"])
    joined = F.array_join(duties, SEPARATOR)
    batches = F.when(F.length(joined) <= limit, F.array(joined)).otherwise(packed(duties, limit))
    resp = F.transform(batches, lambda t, i: _chunk(F.when(F.length(joined) <= limit, F.lit("resp")).otherwise(F.concat(F.lit("resp_"), i.cast("string"))), "resp", t))
    keywords = _listed("关键词: ", clean_list(s["keywords"]))
    substance = F.concat_ws("\n", F.when(~blank(F.col("title")), strip(F.col("title"))), _line("岗位: ", s["job_title"]), _line("摘要: ", s["job_summary"]), keywords)
    raw = F.when((F.size(duties) == 0) & (substance == ""), strip(F.col("raw_jd_text")))
    fixed = F.array(_chunk(F.lit("skill"), "skill", skills), _chunk(F.lit("jd_raw"), "jd_raw", raw), _chunk(F.lit("role"), "role", substance))
    return _filled(F.concat(fixed, resp))


def job_chunks(jobs: DataFrame, limit: int = 4000) -> DataFrame:
    """The jobs' chunks, one row each."""
    return _rows(jobs, "job", job_chunk_list(limit))


def candidate_chunk_list() -> Column:
    """A candidate's chunks: skill, proj_i, work_i (i counts blank entries too), and always cand_role."""
    position = lambda w: F.when(~blank(w["title"]), strip(w["title"])).otherwise(strip(w["position"]))
    projects, work = F.col("projects"), F.col("work_experience")

    def project_text(p: Column) -> Column:
        return F.concat_ws("\n", _line("项目: ", p["name"]), _line("角色: ", p["role"]), _line("", p["description"]))

    def work_text(w: Column) -> Column:
        return F.concat_ws("\n", _line("公司: ", w["company"]), _line("职位: ", position(w)), _line("", w["description"]))

    numbered = lambda prefix, i: F.concat(F.lit(prefix), i.cast("string"))
    none = F.array().cast("array<struct<profile_type:string,block:string,chunk_text:string>>")
    texts = F.coalesce(F.transform(projects, lambda p, i: _chunk(numbered("proj_", i), "project", project_text(p))), none)
    works = F.coalesce(F.transform(work, lambda w, i: _chunk(numbered("work_", i), "work", work_text(w))), none)
    filled = lambda a: F.size(F.filter(a, lambda c: ~blank(c["chunk_text"]))).cast("string")
    names = F.filter(F.transform(F.coalesce(projects["name"], F.array().cast("array<string>")), lambda n: strip(n)), lambda n: n.isNotNull() & (n != ""))
    places = F.transform(work, lambda w: F.concat_ws("·", F.when(~blank(w["company"]), strip(w["company"])), F.when(~blank(position(w)), position(w))))
    places = F.filter(F.coalesce(places, F.array().cast("array<string>")), lambda x: x != "")
    role = F.concat_ws(
        "\n", _listed("方向标签: ", clean_list(F.col("direction_tags"))),
        F.concat(F.lit("经历摘要: 项目 "), filled(texts), F.lit(" 个, 工作/实习 "), filled(works), F.lit(" 个")),
        _listed("项目名: ", F.slice(names, 1, 20), "; "), _listed("公司与职位: ", F.slice(places, 1, 20), "; "),
    )
    fixed = F.array(_chunk(F.lit("skill"), "skill", F.coalesce(_listed("技能: ", clean_list(F.col("skills"))), F.lit(""))), _chunk(F.lit("cand_role"), "cand_role", role))
    return _filled(F.concat(fixed, texts, works))


def candidate_chunks(candidates: DataFrame) -> DataFrame:
    """The candidates' chunks, one row each."""
    return _rows(candidates, "candidate", candidate_chunk_list())


KEY = ["entity_type", "entity_id", "profile_type"]


def embedding_plan(desired: DataFrame, stored: DataFrame, model: str) -> DataFrame:
    """What to do with each chunk: ``keep`` (same text and model, available), ``embed`` or, for stored chunks no longer desired, ``delete``.

    An entity that is in ``desired`` loses its other stored chunks; entities that are not in it at all are left alone.
    """
    old = stored.select(*KEY, F.col("content_hash").alias("old_hash"), F.col("embedding_model").alias("old_model"), F.col("status").alias("old_status"))
    new = desired.select(*KEY, "content_hash")
    same = (F.col("old_status") == "available") & (F.col("old_hash") == F.col("content_hash")) & (F.col("old_model") == model)
    kept = new.join(old, KEY, "left").select(*KEY, "content_hash", F.when(same, "keep").otherwise("embed").alias("action"))
    gone = old.join(new.select("entity_type", "entity_id").distinct(), ["entity_type", "entity_id"], "left_semi").join(new, KEY, "left_anti")
    return kept.unionByName(gone.select(*KEY, F.col("old_hash").alias("content_hash"), F.lit("delete").alias("action")))

"""Rules that turn résumé text into the nested layer-1 record.

A batch of texts becomes one table of lines. Columns say what each line is: its section (the last title carried forward), whether it
begins an entry, and, as a running count of such lines, which entry it belongs to; entries and fields are aggregates over that table. Its vocabulary
is a table of section titles and field labels. What follows (date normalisation, ordering, tiers, binding to a candidate) is column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talweg.functions.lexicons import labels_by_keyword, offered_terms, tier
from talweg.functions.text import blank, strip, time_key, year_month
from talweg.session import spread

# Titles of the sections and of the parts of the last one.
SECTION_TITLES: tuple[tuple[str, str | None, str], ...] = (
    ("education", None, r"教育背景|教育经历|学历|在读经历|Education|Academic\s*Background"),
    ("work_experience", None, r"工作经历|工作经验|实习经历|全职经历|职业经历|任职经历|Employment|Work\s*Experience|Professional\s*Experience|Career\s*History"),
    ("projects", None, r"项目经历|项目经验|主要项目|科研成果|Research\s*Projects|Project\s*Experience|Selected\s*Projects|项目"),
    ("additional", "self_evaluation", r"自我评价|个人评价|自我描述|个人简介|Summary|About\s*Me"),
    ("additional", "skills", r"专业技能|掌握技能|技术栈|职业技能|技能|Skills?|Technical\s*Skills"),
    ("additional", "certificates", r"证书|资质认证|Certifications?"),
    ("additional", "languages", r"语言能力|Languages?"),
    ("additional", "awards", r"荣誉|获奖|奖项|Awards?|Honors?"),
    ("additional", "competitions", r"竞赛|比赛"),
    ("additional", "publications", r"论文|发表|Publications?"),
    ("basic", None, r"基本信息|个人信息|联系方式|个人资料|概况|Profile|Contact|Personal\s*Information"),
)
# Tags of a profile and the words that speak for them.
DIRECTIONS: dict[str, tuple[str, ...]] = {
    "前端": ("前端", "react", "vue", "typescript", "javascript", "webpack", "vite", "小程序", "uni-app", "flutter", "android", "ios", "移动端"),
    "后端": ("后端", "spring", "java", "golang", "go语言", "flask", "django", "fastapi", "微服务", "rest", "rpc", "mysql", "redis", "kafka"),
    "算法": ("算法", "机器学习", "深度学习", "pytorch", "tensorflow", "nlp", "cv", "大模型", "推荐系统", "神经网络"),
    "数据": ("数据分析", "数据挖掘", "数仓", "hive", "spark", "flink", "sql", "bi", "etl"),
    "测试": ("测试", "pytest", "junit", "自动化测试", "接口测试", "性能测试", "selenium"),
    "运维": ("运维", "devops", "docker", "kubernetes", "k8s", "linux", "ci/cd", "jenkins"),
}
# How degrees, schools, spans of years, telephone numbers and links are written.
DEGREE_WORDS = ("本科", "硕士", "研究生", "博士", "大专", "专科", "学士", "本科以上", r"B\.?S\.?", r"M\.?S\.?", r"Ph\.?D\.?", "Bachelor", "Master", "Doctor")
SCHOOL_WORDS = ("大学", "学院", "学校", "University", "College")
SCHOOL_WORDS_IN_LINES = ("大学", "学院", "University")
YEARS = r"(\d{4})\s*[-–—.年]\s*(\d{4}|至今)"
YEAR_START = r"\d{4}\s*[-–—.]"
PERIODS = (r"\d{4}\s*[-–—.]\s*\d{4}", r"\d{4}\s*[-–—.]\s*至今", r"\d{4}\s*至今")
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONES = (r"1[3-9]\d{9}", r"\+?86\s*[-]?\s*1[3-9]\d{9}", r"\(\d{3}\)\s*\d{3}[-]?\d{4}", r"\d{3}[-.\s]?\d{3}[-.\s]?\d{4}")
LINKS = (r"https?://[^\s]+", r"(?:www\.)[^\s]+", r"github\.com/[^\s]+")
PERSON = r"[\u4e00-\u9fa5a-zA-Z\s·]{2,30}"
FOOTERS = (r"\d+", r"第\s*\d+\s*页", r"page\s*\d+\s*/\s*\d+")
ITEM_MARKS = (r"[•·\-\*]\s*", r"\d+[\.、）)]\s*")
LANGUAGE_WORDS = ("CET", "TEM", "IELTS", "TOEFL", "日语", "英语", "English")
LABELS = {"location": "现居|居住地|地址", "target_role": "求职意向|期望职位|意向岗位"}

LAYER1 = (
    "struct<basic:struct<name:string,phone:string,email:string,location:string,birth_text:string,target_role:string,links:array<string>,raw_block:string>,"
    "education:array<struct<school:string,degree:string,major:string,start:string,end:string,raw_block:string>>,"
    "work_experience:array<struct<company:string,job_role:string,job_type:string,start:string,end:string,descriptions:array<string>,raw_block:string>>,"
    "projects:array<struct<project_name:string,role:string,start:string,end:string,descriptions:array<string>,raw_block:string>>,"
    "skills:array<string>,additional:struct<languages:array<string>,certificates:array<string>,awards:array<string>,self_evaluation:string,raw_block:string>>"
)


def _any_of(words: tuple[str, ...]) -> str:
    return f"(?:{'|'.join(words)})"


_TITLE = "|".join(titles for _, _, titles in SECTION_TITLES)
_I = re.IGNORECASE


def _first(texts: pd.Series, pattern: str, flags: int = 0) -> pd.Series:
    """The first match in each text, or an empty string."""
    return texts.str.extract(f"({pattern})", flags=flags)[0].fillna("")


def line_table(texts: pd.Series) -> pd.DataFrame:
    """One row a line: doc (place of the text), line, bare, named (section that the line is a title of), title, section, part.

    A title is a short line that is no list item; after 30 lines it needs a blank line next to it.
    """
    whole = texts.fillna("").str.replace("\r\n", "\n", regex=False).str.replace("\r", "\n", regex=False).reset_index(drop=True)
    t = whole.str.split("\n").rename("line").rename_axis("doc").explode().reset_index()
    t["bare"] = t["line"].str.strip()
    filled = (t["bare"] != "").astype("int8")
    between = filled.groupby(t["doc"]).shift(1, fill_value=0) + filled.groupby(t["doc"]).shift(-1, fill_value=0) == 2
    # few lines are titles of anything; the first rule of theirs says of what
    titles = t.loc[t["bare"].str.fullmatch(rf"(?:{_TITLE})\s*[:：]?", flags=_I), "bare"]
    rule = pd.Series(-1, index=titles.index)
    for n in reversed(range(len(SECTION_TITLES))):
        rule[titles.str.fullmatch(rf"(?:{SECTION_TITLES[n][2]})\s*[:：]?", flags=_I)] = n
    t["named"] = rule.map(lambda n: SECTION_TITLES[n][0]).reindex(t.index)
    short = (t["bare"].str.len() <= 40) & ~t["bare"].str.match(_any_of(ITEM_MARKS)) & ~t["bare"].str.fullmatch(_any_of(FOOTERS), flags=_I)
    t["title"] = t["named"].where(short & ((t.groupby("doc").cumcount() < 30) | ~between))
    part = rule.map(lambda n: SECTION_TITLES[n][1]).reindex(t.index).where(t["title"] == "additional")
    t["section"] = t.groupby("doc")["title"].ffill().fillna("basic")
    t["part"] = part.groupby(t["doc"]).ffill()
    return t


def _blocks(lines: pd.DataFrame, starts: pd.Series, text: str = "line") -> pd.DataFrame:
    """doc, entry, block, head: the lines of each entry joined, and its first one; an entry begins at each line of ``starts``."""
    numbered = lines.assign(entry=starts.astype(int).groupby(lines["doc"]).cumsum())
    out = numbered.groupby(["doc", "entry"], sort=True)[text].agg(block="\n".join, head="first").reset_index()
    return out[out["block"].str.strip() != ""]


def _per_doc(entries: pd.DataFrame, names: list[str], most: int) -> pd.Series:
    """The records of each doc, in order, as a list."""
    kept = entries[entries.groupby("doc").cumcount() < most]
    return pd.Series(kept[names].to_dict("records"), index=kept["doc"], dtype=object).groupby(level=0).agg(list)


def education_entries(t: pd.DataFrame) -> pd.Series:
    """Records by doc. Paragraphs that name a degree, a school or begin with a year begin an entry; in a lone paragraph, lines do."""
    degree, school = _any_of(DEGREE_WORDS), _any_of(SCHOOL_WORDS)
    lines = t[(t["section"] == "education") & (t["named"] != "education")]
    filled = lines["bare"] != ""
    paragraph = (filled & ~filled.groupby(lines["doc"]).shift(1, fill_value=False)).groupby(lines["doc"]).cumsum()
    paragraphs = lines[filled].assign(paragraph=paragraph).groupby(["doc", "paragraph"], sort=True)["line"].agg("\n".join).str.strip().rename("line").reset_index()
    p = paragraphs["line"]
    blocks = _blocks(paragraphs, p.str[:40].str.contains(degree, flags=_I) | p.str.match(YEAR_START) | p.str.contains(school, flags=_I))
    lone = (blocks.groupby("doc")["block"].transform("size") == 1) & blocks["block"].str.contains("\n", regex=False)
    inner = blocks.loc[lone, ["doc", "block"]].assign(line=lambda d: d["block"].str.split("\n")).explode("line", ignore_index=True)
    inner = inner[inner["line"].str.strip() != ""] if len(inner) else inner.assign(line="")
    x = inner["line"].astype(str)
    begins = x.str.strip().str.match(YEAR_START) | (x.str[:30].str.contains(degree, flags=_I) & x.str.contains(_any_of(SCHOOL_WORDS_IN_LINES), flags=_I))
    out = pd.concat([blocks[~lone], _blocks(inner, begins)]).sort_values(["doc", "entry"], kind="stable").reset_index(drop=True)
    each = out["block"].str.split("\n").explode().str.strip()
    each = each[each != ""]
    named = each[each.str.contains(school, flags=_I)].groupby(level=0).first()
    years = out["block"].str.extract(YEARS)
    out = out.assign(
        school=named.reindex(out.index).fillna(each.groupby(level=0).first()).fillna("").str[:200], degree=_first(out["block"], degree, _I), major="", start=years[0].fillna(""), end=years[1].fillna(""), raw_block=out["block"])
    return _per_doc(out, ["school", "degree", "major", "start", "end", "raw_block"], 12)


def dated_entries(t: pd.DataFrame, section: str) -> pd.Series:
    """Records by doc of a work or project section; a line that begins with a span of years begins one."""
    period = _any_of(PERIODS)
    lines = t[(t["section"] == section) & (t["named"] != section)]
    out = _blocks(lines, lines["bare"].str.match(period)).reset_index(drop=True)
    head = out["head"].str.strip()
    dated = head.str.extract(rf"^({period})\s+(.+)$")
    has = dated[0].notna()
    span = dated[0].fillna("").str.extract(r"(\d{4}).*?(\d{4}|至今)").fillna("")
    who = dated[1].where(has, head).str.strip()
    each = out["block"].str.split("\n").str[1:].explode().fillna("").str.strip()
    items = each[each.str.match(_any_of(ITEM_MARKS))].str.replace(r"^[•·\-\*\d\.、）)]\s*", "", regex=True).str[:500].groupby(level=0).agg(list).reindex(out.index)
    out = out.assign(start=span[0], end=span[1], descriptions=[x if isinstance(x, list) else [] for x in items], raw_block=out["block"].str.strip())
    if section == "work_experience":
        cut_at = who.str.split(r"\s{2,}|\t+|　+", n=1, regex=True)
        out = out.assign(
            company=cut_at.str[0].where(has, who).str[:120], job_role=cut_at.str[1].where(has).fillna("").str[:120],
            job_type=out["block"].str.contains("实习|internship", flags=_I).map({True: "internship", False: "fulltime"}))
        return _per_doc(out, ["company", "job_role", "job_type", "start", "end", "descriptions", "raw_block"], 20)
    out = out.assign(project_name=who.str[:120], role="")
    return _per_doc(out, ["project_name", "role", "start", "end", "descriptions", "raw_block"], 20)


def basic_fields(t: pd.DataFrame, docs: pd.RangeIndex) -> pd.Series:
    """The basic record of each doc."""
    lines = t[t["section"] == "basic"]
    text = lines.groupby("doc")["line"].agg("\n".join).reindex(docs).fillna("")
    early = lines[lines["bare"] != ""]
    early = early[early.groupby("doc").cumcount() < 8]
    bare = early["bare"]
    name = early[bare.str.fullmatch(PERSON) & ~bare.str.contains(EMAIL) & ~bare.str.contains(_any_of(PHONES))].groupby("doc")["bare"].first().reindex(docs).fillna("")
    labelled = {k: text.str.extract(rf"(?:{words})[:：]\s*([^\n]+)")[0].fillna("").str.strip().str[:120] for k, words in LABELS.items()}
    links = text.str.findall(_any_of(LINKS), flags=_I).map(lambda found: [x.rstrip(").,;，。") for x in found][:8])
    frame = pd.DataFrame({
        "name": name, "phone": _first(text, _any_of(PHONES)).str.strip(), "email": _first(text, EMAIL), "location": labelled["location"], "birth_text": "", "target_role": labelled["target_role"],
        "links": links, "raw_block": text})
    return pd.Series(frame.to_dict("records"), index=docs)


def additional_fields(t: pd.DataFrame, docs: pd.RangeIndex) -> tuple[pd.Series, pd.Series]:
    """(skills, the additional record) of each doc."""
    def listed(rows: pd.Series, most: int) -> pd.Series:
        kept = rows[rows.groupby(level=0).cumcount() < most].groupby(level=0).agg(list).reindex(docs)
        return kept.map(lambda x: x if isinstance(x, list) else [])

    inside = t[t["section"] == "additional"]
    told = inside[inside["title"].isna() & (inside["bare"] != "")].set_index("doc")
    of = {part: told.loc[told["part"] == part, "bare"] for part in ("skills", "languages", "certificates", "awards", "self_evaluation")}
    # what follows the first colon of either form, and then the first of the other one
    skills = of["skills"].str.split("：", n=1).str[-1].str.split(":", n=1).str[-1].str.split(r"[,，、;；/\s|]+", regex=True).explode().dropna()
    spoken = of["languages"]
    pair = spoken.str.extract(r"^(.{1,40}?)[：:]\s*.+$")[0].str.strip()
    spoken = pair.fillna(spoken.where(spoken.str.contains(_any_of(LANGUAGE_WORDS), flags=_I)).str[:40]).dropna()
    about = of["self_evaluation"].groupby(level=0).agg("\n".join).reindex(docs).fillna("")
    block = inside.groupby("doc")["line"].agg("\n".join).reindex(docs).fillna("")
    record = pd.DataFrame({
        "languages": listed(spoken, 20), "certificates": listed(of["certificates"].str[:120], 30), "awards": listed(of["awards"].str[:120], 30), "self_evaluation": about, "raw_block": block})
    return listed(skills[skills.str.len() >= 2], 50), pd.Series(record.to_dict("records"), index=docs)


def parse_texts(texts: pd.Series) -> tuple[list[dict], list[list[str]]]:
    """(layer-1 records, warnings) of the texts."""
    t, docs = line_table(texts), pd.RangeIndex(len(texts))
    skills, additional = additional_fields(t, docs)
    entries = {"education": education_entries(t), "work_experience": dated_entries(t, "work_experience"), "projects": dated_entries(t, "projects")}
    record = pd.DataFrame({"basic": basic_fields(t, docs), **{k: v.reindex(docs).map(lambda x: x if isinstance(x, list) else []) for k, v in entries.items()}, "skills": skills, "additional": additional}, index=docs)
    switched = t["title"].notna() & (t["title"] != "basic")
    switched = switched.groupby(t["doc"]).any()
    warnings = [["empty_text"] if not text else [] if switched[i] else ["no_section_headers_detected"] for i, text in enumerate(texts.fillna(""))]
    return record.to_dict("records"), warnings


def parse_text(text: str | None) -> tuple[dict, list[str]]:
    """(layer-1 record, warnings) of one text."""
    records, warnings = parse_texts(pd.Series([text], dtype=object))
    return records[0], warnings[0]


def parse_documents(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` with layer1, warnings, parse_status (partial if there are warnings) and the first 800 characters as preview. Null is empty text."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            # an Arrow batch of long texts is a large table of lines, so it is taken in parts of some megabytes
            part = b[text].str.len().fillna(0).cumsum() // 4_000_000
            for _, rows in b.groupby(part, sort=True):
                records, warnings = parse_texts(rows[text])
                yield pd.DataFrame({
                    key: rows[key].to_numpy(), "layer1": records, "warnings": warnings, "parse_status": ["partial" if w else "success" for w in warnings], "preview": rows[text].fillna("").str[:800].to_numpy()})

    return spread(df.select(key, text)).mapInPandas(run, f"`{key}` {kind}, layer1 {LAYER1}, warnings array<string>, parse_status string, preview string")


def latest_first(entries: Column) -> Column:
    """Entries with normalised dates, the latest end (then start) first; equal ones keep their order."""
    dated = F.transform(entries, lambda e, i: F.struct(
        -time_key(year_month(e["end"])).alias("k1"), -time_key(year_month(e["start"])).alias("k2"), i.alias("i"),
        e.withField("start", year_month(e["start"])).withField("end", year_month(e["end"])).alias("e")))
    return F.transform(F.array_sort(dated), lambda x: x["e"])


def normal_blocks(layer1: Column, tiers: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The record with dates normalised, entries ordered and schools given their tier."""
    schools = F.transform(latest_first(layer1["education"]), lambda e: e.withField("school", strip(e["school"])).withField("school_tier", tier(e["school"], tiers or {})))
    work = F.transform(latest_first(layer1["work_experience"]), lambda e: e.withField("job_type", F.when(blank(e["job_type"]), "unknown").otherwise(e["job_type"])))
    return layer1.withField("education", schools).withField("work_experience", work).withField("projects", latest_first(layer1["projects"]))


def candidate_record(layer1: Column) -> Column:
    """What a candidate takes over from a résumé; years of experience and summary are never derived."""
    span = lambda e: F.concat_ws(" - ", F.when(e["start"] != "", e["start"]), F.when(e["end"] != "", e["end"]))
    education = F.transform(layer1["education"], lambda e: F.struct(F.when(blank(e["degree"]), "未知").otherwise(e["degree"]).alias("degree"), e["school"].alias("school"), e["major"].alias("major")))
    work = F.transform(layer1["work_experience"], lambda e: F.struct(
        span(e).alias("period"), e["company"].alias("company"), e["job_role"].alias("title"), e["job_role"].alias("position"), F.substring(F.array_join(e["descriptions"], "\n"), 1, 500).alias("description")))
    projects = F.transform(layer1["projects"], lambda e: F.struct(e["project_name"].alias("name"), e["role"].alias("role"), F.substring(F.array_join(e["descriptions"], "\n"), 1, 1000).alias("description")))
    evidence = F.concat_ws(" ", F.array_join(layer1["skills"], " "), F.array_join(layer1["work_experience"]["raw_block"], " "), F.array_join(layer1["projects"]["raw_block"], " "))
    return F.struct(
        layer1["basic"]["name"].alias("name"), layer1["basic"]["email"].alias("email"), layer1["basic"]["phone"].alias("phone"), education.alias("education"), work.alias("work_experience"),
        projects.alias("projects"), offered_terms(layer1["skills"]).alias("skills"), labels_by_keyword(evidence, DIRECTIONS).alias("direction_tags"))

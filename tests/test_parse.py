import io
import json
import zipfile

from pyspark.sql import functions as F

from talweg.operators.model_answers import keep_grounded, layer1_of_answer, no_provider, readable, routed, shape_error
from talweg.operators.resume_parse import candidate_record, normal_blocks, parse_documents, parse_text
from talweg.sources.files import office_text, page_text, pages_of, read_files, recognised_texts, word_list
from talweg.streaming.queue import changed_entities, handled, run_queue, task_stream

TEXT = """张 三
a.b@c.com 13800001234
现居：上海
求职意向: 后端工程师
https://github.com/x).

教育背景
2018-2022 北方大学 本科
2015-2018 南方学院 大专

工作经历
2022-至今 甲公司  工程师
- 用 Kafka 做了很多事情
- 另一件事
2020-2022 乙公司（实习）
• 测试

技能
Java, Go / 数据库
语言能力
英语：CET-6
"""


def test_sections_and_entries():
    layer1, warnings = parse_text(TEXT)
    assert warnings == []
    b = layer1["basic"]
    assert (b["name"], b["email"], b["phone"], b["location"], b["target_role"]) == ("张 三", "a.b@c.com", "13800001234", "上海", "后端工程师")
    assert b["links"] == ["https://github.com/x"]
    assert [(e["school"][:14], e["degree"], e["start"], e["end"]) for e in layer1["education"]] == [("2018-2022 北方大学", "本科", "2018", "2022"), ("2015-2018 南方学院", "大专", "2015", "2018")]
    w = layer1["work_experience"]
    assert [(x["company"], x["job_role"], x["job_type"], x["end"]) for x in w] == [("甲公司", "工程师", "fulltime", "至今"), ("乙公司（实习）", "", "internship", "2022")]
    assert w[0]["descriptions"] == ["用 Kafka 做了很多事情", "另一件事"]
    assert layer1["skills"] == ["Java", "Go", "数据库"] and layer1["additional"]["languages"] == ["英语"]
    assert parse_text("")[1] == ["empty_text"] and parse_text("x\ny")[1] == ["no_section_headers_detected"]
    assert parse_text("")[0]["education"] == [] and parse_text(None)[0]["work_experience"] == []


def test_fixed_forms():
    """Alternatives are tried in the order stated; a span of years needs a dash or dot; only University and its like begin an entry within a paragraph."""
    text = "教育背景\n北方大学 本科以上\n\n工作经历\n\n2020-2021 Acme\n2020 2021 Other Co\n- built it\n2019至今 Third  Lead\n\n项目经历\n2018.2019 Search  engine\n技能\na：b:sql, go\n"
    layer1, _ = parse_text(text)
    assert [e["degree"] for e in layer1["education"]] == ["本科"]
    work = layer1["work_experience"]
    assert [(w["company"], w["job_role"], w["start"], w["end"]) for w in work] == [("Acme", "", "2020", "2021"), ("Third", "Lead", "2019", "至今")] and work[0]["descriptions"] == ["built it"]
    assert [(p["project_name"], p["role"]) for p in layer1["projects"]] == [("Search  engine", "")] and layer1["skills"] == ["sql", "go"]
    one = parse_text("教育背景\n2019-2020 A College\nB College 硕士\nC University 博士")[0]["education"]
    assert [e["raw_block"].split("\n")[0] for e in one] == ["2019-2020 A College", "C University 博士"]


def test_documents_and_binding(spark):
    df = spark.createDataFrame([(1, TEXT), (2, None), (3, "word " * 50_000)], "doc_id bigint, text string")
    p = parse_documents(df, "doc_id", "text")
    got = {r["doc_id"]: r for r in p.collect()}
    assert got[1]["parse_status"] == "success" and got[2]["warnings"] == ["empty_text"] and len(got[3]["preview"]) == 800
    n = p.where("doc_id = 1").withColumn("n", normal_blocks(F.col("layer1"), {"985": ("北方大学",)})).withColumn("c", candidate_record(F.col("n"))).first()
    assert [e["school_tier"] for e in n["n"]["education"]] == ["985", "other"]
    assert n["n"]["work_experience"][0]["end"] == "present"
    assert n["c"]["skills"] == ["java", "go", "sql"]
    assert n["c"]["work_experience"][0]["description"].startswith("用 Kafka") and n["c"]["direction_tags"] == ["后端", "测试"]


def test_answers(spark):
    answer = "ok " + json.dumps({
        "basic": {"full_name": "Ann", "mobile": 5, "links": "l"}, "education": [{"university": "U", "from": "2019"}, "bad"],
        "work_experience": [{"employer": "Acme", "title": "Intern dev", "raw_block": "Acme\n职责: built the thing\n技术栈: Go、Rust", "highlights": []}, {"company": "Ghost", "bullets": ["invented"]}],
        "projects": [{"name": "P", "raw_block": "P\nA long line that tells what was done"}], "skills": ["Go", " "], "additional": {"certifications": ["X"]}})
    df = spark.createDataFrame([(answer, "Acme built the thing P A long line that tells what was done Go"), ("nothing", "x"), (None, None)], "a string, s string").withColumn("r", layer1_of_answer(F.col("a")))
    first, second, third = df.collect()
    r = first["r"]
    assert (r["basic"]["name"], r["basic"]["phone"], r["basic"]["links"]) == ("Ann", "5", ["l"]) and r["education"][0]["school"] == "U"
    assert r["work_experience"][0]["descriptions"] == ["built the thing"] and r["work_experience"][0]["job_type"] == "internship"
    assert r["projects"][0]["descriptions"] == ["A long line that tells what was done"] and r["skills"] == ["Go", "Rust"] and r["additional"]["certificates"] == ["X"]
    assert second["r"] is None and third["r"] is None
    kept = df.withColumn("k", keep_grounded(F.col("r"), F.col("s"))).first()["k"]
    assert [w["company"] for w in kept["work_experience"]] == ["Acme"] and kept["skills"] == ["Go"]
    assert [x["e"] for x in df.select(shape_error(F.col("a"), ["basic", "zzz"]).alias("e")).collect()] == ["missing: zzz", "no_json_object", "no_json_object"]
    out = routed(df, [("model", F.when(F.lit(False), F.col("r"))), ("rules", F.col("r"))]).collect()
    assert [x["route"] for x in out] == ["rules", "none", "none"]
    assert spark.range(1).select(no_provider(F.lit("p")).alias("v")).first()["v"] is None
    assert [x[0] for x in df.select(readable(F.col("s"))).collect()] == [False, False, False]


def docx(*paragraphs):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b" hi \xff ")
    (tmp_path / "b.docx").write_bytes(docx("One", " ", "Two"))
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    (tmp_path / "d.doc").write_bytes(b"broken")
    got = {r["path"][-5:]: (r["kind"], r["file_text"]) for r in read_files(spark, str(tmp_path), lambda content: f"{len(content)} bytes").collect()}
    assert got["a.txt"][0] == "text" and got["a.txt"][1].startswith("hi")
    assert got[".docx"] == ("office", "One\n\nTwo") and got["c.pdf"] == ("pdf", "4 bytes") and got["d.doc"] == ("office", "")
    assert office_text(b"") == ""


def test_pages(spark):
    pages = json.dumps([
        {"page_index": 1, "parsing_res_list": [{"block_label": "text", "block_content": "last"}]},
        {"parsing_res_list": [{"block_label": "text", "block_content": "b", "block_order": 2}, {"block_label": "table", "block_content": " a ", "block_order": 1}, {"block_label": "seal", "block_content": "no"},
                              {"block_label": "text", "block_content": "top", "block_bbox": [0, 1, 0, 0]}, {"block_label": "text", "block_content": "low", "block_bbox": [0, 9, 0, 0]}]}])
    row = spark.createDataFrame([(pages,)], "j string").select(page_text(pages_of(F.col("j"))).alias("t")).first()
    assert row["t"] == "a\n\nb\n\ntop\n\nlow\n\nlast"
    assert spark.range(1).select(page_text(pages_of(F.lit("[]"))).alias("t")).first()["t"] == ""
    nested = json.dumps({"x": {"rec_texts": ["a", " ", "b]"]}, "y": [{"rec_texts": ["c"]}]})
    assert spark.range(1).select(recognised_texts(F.lit(nested)).alias("t")).first()["t"] == ["a", "b]", "c"]
    assert word_list("a # x\n\n#y\nb") == ["a", "b"]


def test_queue(spark, tmp_path):
    source, results = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    tasks = [("1", "count"), ("1", "count"), ("2", "odd"), ("3", "fail"), ("4", None)]
    (source / "t.json").write_text("\n".join(json.dumps({"id": i, "task_type": t, "resource_id": "r"}) for i, t in tasks))
    handlers = {"count": lambda df: df.select("id", F.length("resource_id").alias("result")), "fail": lambda df: df.select("id", F.lit(None).alias("result"))}
    for _ in range(2):  # a second start finds nothing new
        run_queue(task_stream(spark, str(source)), handlers, str(results), str(tmp_path / "cp"), once=True).awaitTermination()
    got = {r["id"]: (r["status"], r["error_message"]) for r in spark.read.parquet(str(results)).collect()}
    assert got == {"1": ("completed", None), "2": ("failed", "unknown task type"), "3": ("failed", "no result"), "4": ("failed", "unknown task type")}
    assert handled(spark.read.schema("id string, task_type string").json(str(source)), {}).count() == 4
    changes = spark.createDataFrame([("job", "7")], "entity_type string, entity_id string").withColumn("updated_at", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    assert changed_entities(changes).first()["task_type"] == "job_index_build"

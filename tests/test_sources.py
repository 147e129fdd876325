from lexloom.sources import statutes
from lexloom.streaming import incremental

XML = """<?xml version="1.0" encoding="UTF-8"?>
<Law Era="Heisei" Year="17" Num="86" LawType="Act" PromulgateMonth="7" PromulgateDay="26"><LawNum>平成十七年法律第八十六号</LawNum><LawBody><LawTitle>会社法</LawTitle>
<MainProvision>
<Chapter Num="1"><ChapterTitle>第一章 総則</ChapterTitle>
<Section Num="1"><SectionTitle>第一節 通則</SectionTitle><Article Num="1"><ArticleCaption>（趣旨）</ArticleCaption><ArticleTitle>第一条</ArticleTitle><Paragraph Num="1"><ParagraphNum/><ParagraphSentence><Sentence Num="1">甲。</Sentence><Sentence Num="2">乙。</Sentence></ParagraphSentence>
<Item Num="1"><ItemTitle>一</ItemTitle><ItemSentence><Sentence>丙</Sentence></ItemSentence><Subitem1 Num="1"><Subitem1Title>イ</Subitem1Title><Subitem1Sentence><Sentence>丁</Sentence></Subitem1Sentence></Subitem1></Item></Paragraph></Article></Section>
<Article Num="2"><ArticleTitle>第二条</ArticleTitle><Paragraph Num="1"><ParagraphSentence><Sentence>削除</Sentence></ParagraphSentence></Paragraph></Article></Chapter>
</MainProvision>
<SupplProvision><Article Num="1"><ArticleTitle>第一条</ArticleTitle><Paragraph Num="1"><ParagraphSentence><Sentence>附則文</Sentence></ParagraphSentence></Paragraph></Article></SupplProvision>
</LawBody></Law>"""


def test_law_xml(spark, tmp_path):
    (tmp_path / "417AC0000000086.xml").write_text(XML)
    laws = statutes.read_laws(spark, str(tmp_path))
    head = statutes.law_heads(laws).first()
    assert (head["law_id"], head["title"], str(head["promulgated"])) == ("417AC0000000086", "会社法", "2005-07-26")
    arts = statutes.articles(laws)
    got = [(r["article_number"], r["part"], r["chapter"], r["section"], r["is_deleted"], r["sort_order"]) for r in arts.orderBy("sort_order").collect()]
    assert sorted(g[0] for g in got) == ["1", "1", "2"]
    assert ("1", None, "第一章 総則", "第一節 通則", False) in [g[:5] for g in got]
    assert ("2", None, "第一章 総則", None, True) in [g[:5] for g in got]
    assert got[-1][1] == "附則"
    paras = statutes.paragraphs(arts)
    assert "甲。\n乙。" in [r["content"] for r in paras.collect()]
    assert sorted((r["level"], tuple(r["titles"]), r["content"]) for r in statutes.items(paras).collect()) == [(1, ("一",), "丙"), (2, ("一", "イ"), "丁")]
    assert statutes.law_page(spark, str(tmp_path), 0, 10).count() == 1


def test_embedded_references(spark):
    df = spark.createDataFrame([("L", "<a><b><LawRef>民法</LawRef></b><ArticleRef>第三条</ArticleRef></a>")], "law_id string, xml string")
    assert sorted((r["tag"], r["text"]) for r in statutes.embedded_references(df).collect()) == [("ArticleRef", "第三条"), ("LawRef", "民法")]
    assert df.select(statutes.stripped("xml")).first()[0] == "民法 第三条"


def test_law_list(spark, tmp_path):
    head = ",".join(f"c{i}" for i in range(14))
    row = '法律,平成十七年法律第八十六号,"会社法, 新",よみ,,2005-07-26,,,,2006-05-01,,417AC0000000086,http://x,'
    (tmp_path / "laws.csv").write_text(f"{head}\n{row}\n法律,,,,,,,,,,,,,\n")
    assert [(r["law_id"], r["title"]) for r in statutes.law_list(spark, str(tmp_path / "laws.csv")).collect()] == [("417AC0000000086", "会社法, 新")]


def test_batch_results(spark, tmp_path):
    for n in (2, 10):
        (tmp_path / f"batch_{n}_results.json").write_text('{"lawId": "A", "detected": %d}' % n)
    got = statutes.batch_results(spark, str(tmp_path / "batch_*_results.json"), "lawId string, detected int")
    assert sorted((r["batch"], r["detected"]) for r in got.collect()) == [(2, 2), (10, 10)]


def test_stream_of_documents(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "doc_id long, text string"
    spark.createDataFrame([(1, "see https://a.example/x")], schema).write.parquet(folder)
    for _ in range(2):
        incremental.spans_of_new_documents(incremental.new_files(spark, folder, schema), out, check).awaitTermination(120)
    assert spark.read.parquet(out).where("rule = 'url'").count() == 1
    spark.createDataFrame([(2, "and https://b.example/y")], schema).write.mode("append").parquet(folder)
    incremental.spans_of_new_documents(incremental.new_files(spark, folder, schema), out, check).awaitTermination(120)
    assert spark.read.parquet(out).where("rule = 'url'").count() == 2
    assert incremental.unfinished(spark.createDataFrame([(1,), (3,)], "k int"), spark.createDataFrame([(1,)], "k int"), "k").count() == 1


def test_windowed_counts(spark, tmp_path):
    folder = str(tmp_path / "events")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(folder)
    schema = spark.read.parquet(folder).schema
    stream = incremental.windowed_counts(spark.readStream.schema(schema).parquet(folder))
    q = stream.writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(n) from windowed").first()[0] == spark.read.parquet(folder).count()


ODD = """<Law><LawBody><LawTitle>法</LawTitle><MainProvision>
<Article Num="9"><ArticleTitle>第九条</ArticleTitle><Paragraph Num="1"><ParagraphSentence><Sentence>甲&amp;乙</Sentence><Sentence/></ParagraphSentence></Paragraph></Article>
<Part><PartTitle>第一編</PartTitle><Article Num="1" Delete="true"/><Chapter><ChapterTitle>第一章</ChapterTitle><Section><SectionTitle>第一節</SectionTitle><Article Num="3"><Paragraph/></Article></Section><Article Num="2"><ArticleTitle>x</ArticleTitle><ArticleTitle> 二<b>y</b> </ArticleTitle><ArticleCaption/></Article></Chapter></Part>
<Part><PartTitle>第二編</PartTitle><Article Num="4"/></Part><Chapter><Article Num="5"><Paragraph><Item Num="1"><ItemTitle>一</ItemTitle></Item></Paragraph><Paragraph Num="2"/></Article></Chapter>
</MainProvision><SupplProvision/><SupplProvision><Article Num="1"><ArticleTitle>a</ArticleTitle></Article></SupplProvision></LawBody></Law>"""


def test_articles_of_text_are_those_of_parsed_laws(spark):
    df = spark.createDataFrame([("A", XML.split("?>")[1]), ("B", ODD), ("C", None), ("D", "<Law><LawBody>"), ("E", "<Law/>")], "law_id string, xml string")
    cols = ["law_id", "sort_order", "article_number", "article_title", "caption", "part", "chapter", "section", "content", "is_deleted", "paragraphs"]
    theirs, ours = (a.select(*cols).orderBy("law_id", "sort_order").collect() for a in (statutes.articles(statutes.parse_laws(df)), statutes.articles_of(df)))
    assert ours == theirs
    assert [r["article_number"] for r in ours if r["law_id"] == "B"] == ["9", "1", "2", "3", "4", "5", "1"]
    assert statutes.articles_of(df, paragraphs=False).columns == [c for c in statutes.articles_of(df).columns if c != "paragraphs"]


def test_laws_are_parsed_once(spark):
    df = spark.createDataFrame([("A", ODD)], "law_id string, xml string")
    plan = statutes.articles(statutes.parse_laws(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_xml") == 1 and "Window" not in plan
    below = statutes.items(statutes.paragraphs(statutes.articles_of(df)))._jdf.queryExecution().executedPlan().toString()
    assert below.count("MapInArrow") == 1 and "Union" not in below
    assert "from_xml" not in statutes.embedded_references(df)._jdf.queryExecution().executedPlan().toString()


def test_embedded_references_are_those_of_xpath(spark):
    tags = ("LawRef", "ArticleRef", "ParagraphRef", "ItemRef", "ReferenceToLaw", "ReferenceToArticle", "Ref")
    odd = "<a><LawRef>民<!-- -->法<b>x<Ref> y&lt;</Ref></b>z</LawRef><Ref/><ItemRef>q&#65;<?pi x?>r</ItemRef><LawRefs>n</LawRefs><ArticleRef>\n</ArticleRef></a>"
    df = spark.createDataFrame([("A", odd), ("B", None), ("C", ""), ("D", "<Ref>top</Ref>")], "law_id string, xml string")
    wanted = [(r["law_id"], t, x) for t in tags for r in df.selectExpr("law_id", f"xpath(xml, '//{t}/text()') as x").collect() for x in r["x"] or ()]
    found = statutes.embedded_references(df)
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
    assert statutes.embedded_references(df.selectExpr("law_id", "'<Ref><![CDATA[<q>]]>r</Ref>' as xml")).first()["text"] == "<q>r"
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "Union" not in plan


def test_a_file_for_each_row_without_a_folder_each(spark, tmp_path):
    from lexloom.sources.folders import write_files

    rows = spark.createDataFrame([(f"{i:03}.xml", f"法{i}") for i in range(30)], "name string, value string")
    for n, folder in enumerate((f"{tmp_path}/a b", f"file:{tmp_path}/c", f"file://{tmp_path}/d")):
        write_files(rows, folder)
        held = sorted((tmp_path / ("a b", "c", "d")[n]).iterdir())
        assert [(f.name, f.read_text()) for f in held] == [(f"{i:03}.xml", f"法{i}") for i in range(30)]
    page = statutes.page_of_files(spark, f"file:{tmp_path}/c", 10, 5)
    assert sorted((r["xml"], r["has_more"]) for r in page.collect()) == [(f"法{i}", True) for i in range(10, 15)]


def test_mentions_are_dealt_once_to_tasks_that_follow_their_number(spark, monkeypatch):
    """The heat map groups nothing before the one exchange of its mentions, and a larger table gets more tasks, not larger ones."""
    from lexloom.plans.relational import a27_heat_map
    from lexloom.sources import tables

    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(tables, "MENTIONS_A_TASK", 500)
    heat = a27_heat_map(spark, folder)
    heat.collect()
    plan = heat._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    tasks = spark.read.parquet(f"{folder}/lineitem.parquet").count() // 500 + 1
    assert tasks > 10 and plan.count("hashpartitioning(") == 1 and "hashpartitioning(src#" in plan
    assert tables.edges(spark, folder).rdd.getNumPartitions() == tasks
    assert "HashAggregate" not in plan[plan.index("hashpartitioning(src#") :].split("BroadcastNestedLoopJoin")[0]

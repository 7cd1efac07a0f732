from pyspark.sql import functions as F

from tessella.llm import languages as L

LINES = {
    "en": ["The company announced that the trial was completed on time.", "Patients were treated with the new medicine for several weeks.", "The plant will be able to produce many vials a month.", "No difference was observed between both of the groups."],
    "de": ["Das Unternehmen hat die Studie rechtzeitig abgeschlossen.", "Die Patienten wurden mehrere Wochen mit dem Mittel behandelt.", "Das Werk soll bald viele Arbeitsplätze schaffen und wachsen.", "Über die Höhe der Vergütung haben beide geschwiegen."],
    "es": ["La empresa anunció que el ensayo terminó a tiempo.", "Los pacientes fueron tratados con el nuevo medicamento.", "La fábrica dará trabajo a muchas personas en la ciudad.", "Los efectos adversos más frecuentes fueron las náuseas."],
    "zh": ["公司宣布该试验已按时完成并达到终点。", "患者接受了数周的新药治疗效果良好。", "该项目建成后年产能可达数百万支。", "最常见的不良反应为乏力和恶心。"],
}


def rows():
    out = []
    for c, lines in LINES.items():
        for k in range(40):
            a, b = lines[k % 4], lines[(k + 1) % 4]
            label = "en" if k % 13 == 12 else {"en": "English", "de": "DE", "es": "español", "zh": "zh-CN"}[c]
            out.append((len(out), label, a, [b, a]))
    return out


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ("zh-CN", "中文", "ENG", " de ", "unknown", "", None, "N/A", "pt-BR", "русский")], "l string")
    assert [r[0] for r in df.select(L.label_code(F.col("l"))).collect()] == ["zh", "zh", "en", "de", None, None, None, None, "pt", "ru"]


def test_words():
    assert not L.has_words("LL-8832 +7.9%") and not L.has_words("* * *") and not L.has_words("Novcla Labs") and not L.has_words("")
    assert L.has_words("NEUES WERK SOLL VIELE ARBEITSPLÄTZE SCHAFFEN") and L.has_words("主要终点为")


def test_model(spark):
    model = L.fit([(c, s) for c, lines in LINES.items() for s in lines for _ in range(12)])
    held = [("en", "The board agreed that patients were observed for weeks."), ("de", "DIE STUDIE WURDE MIT DEM NEUEN MITTEL ABGESCHLOSSEN UND BEHANDELT"), ("es", "La empresa dara trabajo con el nuevo medicamento."), ("zh", "该公司宣布新药治疗达到终点。")]
    p = model.probabilities([s for _, s in held])
    assert [model.languages[i] for i in p.argmax(1)] == [c for c, _ in held]
    assert ((p >= 0) & (p <= 1)).all()
    assert L.fit([]) is None and L.fit([("en", LINES["en"][0])]) is None


def test_unnamed(spark):
    r = rows() + [(1000, "en", LINES["en"][0], [LINES["en"][1] + " " + LINES["de"][1], None, "", "* * *", LINES["zh"][0]]), (1001, None, None, []), (1002, "unknown", LINES["de"][0], None)]
    df = spark.createDataFrame(r, "rec_id bigint, lang string, title string, paragraphs array<string>").withColumn("para_no", F.lit("x"))
    got = {tuple(x) for x in L.unnamed_languages(df.drop("para_no")).where("rec_id >= 1000").collect()}
    assert got == {(1000, 1, "de"), (1000, 5, "zh"), (1002, 0, "de")}
    main = {x.rec_id: x.lang for x in L.record_languages(df.drop("para_no")).where("rec_id >= 1000").collect()}
    assert main[1001] is None and main[1002] == "de"
    assert L.unnamed_languages(df.limit(0).drop("para_no")).count() == 0


def test_rejection(spark):
    model = L.fit([(c, s) for c, lines in LINES.items() for s in lines for _ in range(12)])
    text = "The board agreed that patients were observed for weeks."
    most = {}
    for t in (1, 2, 3, 5, 8, 12, 20, 30, 50, 80, 120, 200):
        model.temperature = float(t)
        most[t] = model.probabilities([text])[0].max()
    model.temperature = float(next(t for t, m in most.items() if 0.3 < m < L.LEAST))
    df = spark.createDataFrame([(1, [text])], "rec_id bigint, parts array<string>")
    assert L.languages_of_parts(df, model).count() == 0
    model.temperature = float(max(t for t, m in most.items() if m >= L.LEAST))
    assert [(r.lang, r.confidence >= L.LEAST) for r in L.languages_of_parts(df, model).collect()] == [("en", True)]

"""Rule classifiers: entities, intents, safety, routes, departments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.tables import read
from ledgerloom.functions.text import any_of, found_in

# Lexicons of the rules.
HIGH_RISK = ["胸痛", "呼吸困难", "喘不上气", "喘不过气", "气短", "昏迷", "意识不清", "抽搐", "大出血", "咯血", "咳血", "呕血", "黑便", "持续高热", "高热不退", "严重过敏", "过敏性休克", "自杀", "轻生", "想死", "自残", "过量服药", "吃多了药", "药吃多了", "中毒", "休克"]
DOSAGE = ["吃多少", "用量", "剂量", "几片", "几粒", "mg", "毫克", "加量", "减量", "一天几次", "一次几片", "一次几粒", "能不能一起吃", "可以一起吃", "联合用药"]
SYMPTOMS = {
    "咳嗽": ["咳嗽", "咳", "干咳", "咳痰", "有点咳", "一直咳"],
    "发热": ["发热", "发烧", "低烧", "高烧", "体温高"],
    "头痛": ["头痛", "头疼", "脑袋疼"],
    "胸闷": ["胸闷", "胸口闷", "气短"],
    "呼吸困难": ["呼吸困难", "喘不上气", "喘不过气", "气喘"],
    "腹痛": ["腹痛", "肚子痛", "肚子疼", "胃疼"],
    "腹泻": ["腹泻", "拉肚子", "拉稀"],
    "恶心": ["恶心", "想吐", "反胃"],
    "呕吐": ["呕吐", "吐了", "一直吐"],
    "乏力": ["乏力", "没力气", "无力", "疲劳"],
    "皮疹": ["皮疹", "起疹子", "红疹", "疹子"],
    "鼻塞": ["鼻塞", "鼻子堵"],
    "流涕": ["流涕", "流鼻涕"],
    "咽痛": ["咽痛", "嗓子疼", "喉咙痛", "喉咙疼"],
}
DISEASES = ["百日咳", "肺炎", "感冒", "流感", "支气管炎", "哮喘", "肺结核", "糖尿病", "高血压", "冠心病", "胃炎", "肠炎"]
DRUG_ENDINGS = ["片", "胶囊", "颗粒", "口服液", "糖浆", "注射液", "丸", "散"]
DRUG_NAMES = ["红霉素", "阿莫西林", "布洛芬"]
INTENT_WORDS = {
    "symptom_to_disease": ["什么病", "可能是", "怎么回事", "原因", "有点", "症状"],
    "disease_profile": ["是什么", "介绍", "简介", "病因", "预防", "治疗", "检查", "并发"],
    "drug_info": ["药", "用药", "吃什么药", "生产商", "厂家"],
    "diet_advice": ["吃什么", "忌口", "宜吃", "不能吃", "饮食"],
}
#: (words, intent, needs the record, writes, confidence), in order of precedence after high risk.
ROUTES = [
    (["提醒我", "提醒", "随访", "测量计划", "创建任务", "帮我记"], "health_task", True, True, 0.99),
    (["附近医院", "哪里就医", "去哪里看", "去哪个科", "挂什么号", "医院", "急诊在哪"], "care_navigation", False, False, 0.98),
    (["趋势", "变化", "波动", "升高", "降低", "历次", "时间线", "就诊记录"], "timeline_trend", True, False, 0.98),
    (["我的报告", "体检报告", "检查报告", "化验报告", "影像检查报告", "尿检报告", "检查单", "检验单"], "report_interpretation", True, False, 0.98),
    (["我的病史", "既往病史", "我的过敏", "我的用药", "我目前正在使用", "我的病历", "我的档案"], "patient_record_query", True, False, 0.98),
]
MEDICATION_WORDS = ["阿莫西林", "青霉素过敏", "药物过敏"]
LIFESTYLE_WORDS = ["饮食", "忌口", "吃什么", "运动", "睡眠", "减重", "生活方式"]
DEPARTMENTS = [
    (["胸痛", "心慌", "心悸", "冠心病", "高血压"], "心血管内科"),
    (["咳嗽", "咳痰", "发热", "呼吸", "胸闷", "气短", "哮喘"], "呼吸内科"),
    (["腹痛", "胃痛", "腹泻", "恶心", "呕吐", "便血"], "消化内科"),
    (["头痛", "头晕", "抽搐", "意识", "肢体无力"], "神经内科"),
    (["皮疹", "瘙痒", "皮肤", "红疹"], "皮肤科"),
    (["骨折", "扭伤", "关节", "腰痛", "颈椎"], "骨科"),
    (["儿童", "孩子", "婴儿", "宝宝"], "儿科"),
    (["孕妇", "怀孕", "月经", "妇科"], "妇产科"),
    (["眼睛", "视力", "眼痛"], "眼科"),
    (["耳鸣", "鼻塞", "咽痛", "喉咙"], "耳鼻咽喉科"),
]
EMERGENCY, GENERAL = "急诊科", "全科医学科或普通内科"
PROTECTED = ["urgent_care", "medication_safety", "patient_record_query", "timeline_trend", "health_task", "care_navigation"]


def safety(text: Column, high_risk=HIGH_RISK, dosage=DOSAGE) -> Column:
    """struct<high_risk_terms, dosage_terms, high_risk, dosage>; dosage terms whatever their case."""
    high, dose = found_in(text, high_risk), found_in(F.lower(text), [t.lower() for t in dosage])
    return F.struct(high.alias("high_risk_terms"), dose.alias("dosage_terms"), (F.size(high) > 0).alias("high_risk"), (F.size(dose) > 0).alias("dosage"))


def symptoms(text: Column, aliases: dict[str, list[str]] = SYMPTOMS) -> Column:
    """Names of the groups of which an alias occurs."""
    return F.filter(F.array(*[F.when(any_of(text, a), F.lit(name)) for name, a in aliases.items()]), lambda x: x.isNotNull())


def drugs(text: Column, endings=DRUG_ENDINGS, names=DRUG_NAMES) -> Column:
    tokens = F.regexp_extract_all(text, F.lit(r"[一-鿿A-Za-z0-9]{2,12}"), F.lit(0))
    return F.array_distinct(F.filter(tokens, lambda t: F.exists(F.array(*[F.lit(e) for e in endings]), lambda e: F.endswith(t, e)) | any_of(t, names)))


def intent(text: Column, aliases=SYMPTOMS, diseases=DISEASES, endings=DRUG_ENDINGS, words=INTENT_WORDS) -> Column:
    sick, ill = any_of(text, [a for group in aliases.values() for a in group]), any_of(text, diseases)
    # tokens are only cut where an ending or a name occurs at all
    drug = any_of(text, [*endings, *DRUG_NAMES]) & (F.size(drugs(text, endings)) > 0)
    return (
        F.when(any_of(text, words["drug_info"]) | drug, "drug_info")
        .when(sick & any_of(text, words["symptom_to_disease"]), "symptom_to_disease")
        .when(ill & any_of(text, words["diet_advice"]), "diet_advice")
        .when(ill | any_of(text, words["disease_profile"]), "disease_profile")
        .when(sick, "symptom_to_disease")
        .otherwise("general_medical_qa")
    )


def route(text: Column, high_risk=HIGH_RISK, dosage=DOSAGE, routes=ROUTES, aliases=SYMPTOMS, low: Column | None = None) -> Column:
    """struct<intent, complexity, needs_record, writes, confidence>: the first rule that fits. `low` is the trimmed text in lower case, if there is a column of it already."""
    low = F.lower(F.trim(text)) if low is None else low
    got = lambda name, complex_, record, writes, sure: F.struct(F.lit(name).alias("intent"), (complex_ if isinstance(complex_, Column) else F.lit(complex_)).alias("complexity"), F.lit(record).alias("needs_record"), F.lit(writes).alias("writes"), F.lit(sure).alias("confidence"))
    n = F.size(symptoms(low, aliases))
    out = F.when(any_of(text, high_risk), got("urgent_care", "simple", False, False, 1.0))
    for words, name, record, writes, sure in routes:
        out = out.when(any_of(low, [w.lower() for w in words]), got(name, "complex" if name == "timeline_trend" else "simple", record, writes, sure))
    out = out.when(any_of(low, [x.lower() for x in dosage]) | (intent(low) == "drug_info") | any_of(low, MEDICATION_WORDS), got("medication_safety", "simple", True, False, 0.97))
    out = out.when(any_of(low, LIFESTYLE_WORDS), got("lifestyle_guidance", "simple", False, False, 0.95))
    out = out.when(n > 0, got("symptom_assessment", F.when(n > 1, "complex").otherwise("simple"), False, False, 0.94))
    return out.otherwise(got("general_medical_qa", "simple", False, False, 0.90))


def tiered_route(rule: Column, model: Column, protected=PROTECTED) -> Column:
    """The model's intent, but for protected intents of the rules; a missing one keeps the rule's. A model never grants writes."""
    use = model.isNotNull() & ~rule["intent"].isin(protected)
    return F.struct(F.when(use, model["intent"]).otherwise(rule["intent"]).alias("intent"), rule["writes"].alias("writes"), F.when(use, "model").otherwise("rules").alias("source"))


def department(text: Column, rules=DEPARTMENTS, high_risk=HIGH_RISK) -> Column:
    out = F.when(any_of(text, high_risk), EMERGENCY)
    for terms, name in rules:
        out = out.when(any_of(text, terms), name)
    return out.otherwise(GENERAL)


def evidence_action(high_risk: Column, confidence: Column, missing: Column, writes: Column, name: Column) -> Column:
    """Order of precedence: high risk, low confidence, missing fields, task, navigation, answer."""
    return F.when(high_risk, "urgent_guidance").when(confidence < 0.6, "clarify").when(missing > 0, "ask_missing").when(writes, "confirm_task").when(name == "care_navigation", "navigate").otherwise("answer")


#: Rules in words of the synthetic tables, so that each branch is taken there.
_FIX = {"high": ["idiot", "license"], "dose": ["MG ", "und zu"], "routes": [(["wher "], "health_task", True, True, 0.99), (["que la"], "care_navigation", False, False, 0.98), (["tiontion"], "timeline_trend", True, False, 0.98)], "sym": {"s1": ["ingon", "oning"], "s2": ["hathe"], "s3": ["edend"]}, "dep": [(["der die"], "d1"), (["le la", "de la"], "d2"), (["ation"], "d3")]}


def _asked(spark, d):
    """Texts of which some name a drug by its ending, and some a way of living."""
    more = F.when(F.col("doc_id") % 11 == 0, " 维生素片").when(F.col("doc_id") % 11 == 1, " 睡眠").otherwise("")
    return _texts(spark, d).select("doc_id", F.concat("text", more).alias("text"))


def _texts(spark, d):
    return read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def nd3_safety(spark, d):
    s = safety(F.col("text"), _FIX["high"], _FIX["dose"])
    return _texts(spark, d).select("doc_id", s.alias("s")).select("doc_id", F.array_join("s.high_risk_terms", ",").alias("high_terms"), F.array_join("s.dosage_terms", ",").alias("dosage_terms"), "s.high_risk", "s.dosage")


def nd1_entities(spark, d):
    return _texts(spark, d).select("doc_id", F.array_join(symptoms(F.col("text"), _FIX["sym"]), ",").alias("symptoms"), F.size(drugs(F.col("text"), ["tion", "ung"], ["idiot"])).cast("bigint").alias("n_drugs"))


def nd4_router(spark, d):
    asked = _asked(spark, d).withColumn("low", F.lower(F.trim("text")))
    return asked.select("doc_id", route(F.col("text"), _FIX["high"], _FIX["dose"], _FIX["routes"], _FIX["sym"], F.col("low")).alias("r")).select("doc_id", "r.*")


def nd14_triage(spark, d):
    return _texts(spark, d).select("doc_id", department(F.col("text"), _FIX["dep"], _FIX["high"]).alias("department"))


def nd6_plan(spark, d):
    e = read(spark, d, "events")
    v = F.col("value")
    return e.select("event_id", evidence_action(v > 450, v % 1, (F.col("event_id") % 7 == 0).cast("int"), F.col("event_type") == "signup", F.when(F.col("event_type") == "view", "care_navigation").otherwise("x")).alias("action"))


QUERIES = {f.__name__: f for f in (nd1_entities, nd3_safety, nd4_router, nd6_plan, nd14_triage)}
_has = lambda c, ts: "(" + " OR ".join(f"contains({c}, '{t}')" for t in ts) + ")"
_list = lambda c, ts: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains({c}, '{t}') THEN '{t}' END" for t in ts) + "], lambda x: x IS NOT NULL), ',')"
_n = " + ".join(f"{_has('lower(trim(text))', a)}::INT" for a in _FIX["sym"].values())
SQL = {
    "nd3_safety": f"SELECT doc_id, {_list('text', _FIX['high'])} AS high_terms, {_list('lower(text)', [x.lower() for x in _FIX['dose']])} AS dosage_terms, {_has('text', _FIX['high'])} AS high_risk, {_has('lower(text)', [x.lower() for x in _FIX['dose']])} AS dosage FROM documents",
    "nd1_entities": "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_has('text', a)} THEN '{n}' END" for n, a in _FIX["sym"].items()) + "], lambda x: x IS NOT NULL), ',') AS symptoms, len(list_distinct(list_filter(regexp_extract_all(coalesce(text, ''), '[一-鿿A-Za-z0-9]{2,12}'), lambda t: suffix(t, 'tion') OR suffix(t, 'ung') OR contains(t, 'idiot')))) AS n_drugs FROM documents",
    "nd4_router": f"""
        WITH r AS (SELECT doc_id, ({_n}) AS n, CASE WHEN {_has("text", _FIX["high"])} THEN 'urgent_care' {" ".join(f"WHEN {_has('lower(trim(text))', w)} THEN '{name}'" for w, name, *_ in _FIX["routes"])}
            WHEN {_has("lower(trim(text))", [x.lower() for x in _FIX["dose"]])} OR doc_id % 11 = 0 THEN 'medication_safety' WHEN doc_id % 11 = 1 THEN 'lifestyle_guidance' WHEN ({_n}) > 0 THEN 'symptom_assessment' ELSE 'general_medical_qa' END AS intent FROM documents)
        SELECT doc_id, intent, CASE WHEN intent = 'timeline_trend' OR intent = 'symptom_assessment' AND n > 1 THEN 'complex' ELSE 'simple' END AS complexity, intent IN ('health_task', 'timeline_trend', 'medication_safety') AS needs_record, intent = 'health_task' AS writes,
            CASE intent WHEN 'urgent_care' THEN 1.0 WHEN 'health_task' THEN 0.99 WHEN 'care_navigation' THEN 0.98 WHEN 'timeline_trend' THEN 0.98 WHEN 'medication_safety' THEN 0.97 WHEN 'lifestyle_guidance' THEN 0.95 WHEN 'symptom_assessment' THEN 0.94 ELSE 0.9 END::DOUBLE AS confidence FROM r""",
    "nd6_plan": "SELECT event_id, CASE WHEN value > 450 THEN 'urgent_guidance' WHEN value % 1 < 0.6 THEN 'clarify' WHEN event_id % 7 = 0 THEN 'ask_missing' WHEN event_type = 'signup' THEN 'confirm_task' WHEN event_type = 'view' THEN 'navigate' ELSE 'answer' END AS action FROM events",
    "nd14_triage": f"SELECT doc_id, CASE WHEN {_has('text', _FIX['high'])} THEN '{EMERGENCY}' " + " ".join(f"WHEN {_has('text', t)} THEN '{n}'" for t, n in _FIX["dep"]) + f" ELSE '{GENERAL}' END AS department FROM documents",
}

"""What a prompt asks for: anchors, intents, sections, families of questions, focus phrases and the bonuses of what answers them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import _all, _c, match_text, tokens

#: Digits of Chinese numerals and Roman letters.
CHINESE = {"零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
#: Kinds of anchors and the patterns of their numbers, in the order in which they are tried.
_N, _CN = "([0-9ivxlcdm]+)", "([零一二两三四五六七八九十百\\d]+)"
ANCHORS = [
    ("figure", f"(?i)\\bfig(?:ure)?\\.?\\s*{_N}\\b"),
    ("table", f"(?i)\\btable\\.?\\s*{_N}\\b"),
    ("equation", f"(?i)\\b(?:eq(?:uation)?|formula)\\.?\\s*[(\\[（]?\\s*{_N}\\s*[)\\]）]?"),
    *((kind, f"(?i)\\b{kind}\\.?\\s*{_N}\\b") for kind in ("theorem", "lemma", "definition", "proposition", "corollary")),
    ("figure", f"第\\s*{_CN}\\s*(?:张)?图"),
    ("table", f"第\\s*{_CN}\\s*表"),
    ("equation", f"(?:公式|式)\\s*[(\\[（]?\\s*{_CN}\\s*[)\\]）]?"),
    *((kind, f"{word}\\s*[(\\[（]?\\s*{_CN}\\s*[)\\]）]?") for kind, word in (("theorem", "定理"), ("lemma", "引理"), ("definition", "定义"), ("proposition", "命题"), ("corollary", "推论"))),
]
#: Names of anchors, what their numbers look like in a text (N stands for the number), and weights.
LABELS = {
    "figure": ("figure", "fig", "图", "张图"), "table": ("table", "表"), "equation": ("equation", "eq", "formula", "公式", "式"), "theorem": ("theorem", "定理"),
    "lemma": ("lemma", "引理"), "definition": ("definition", "定义"), "proposition": ("proposition", "命题"), "corollary": ("corollary", "推论"),
}
NUMBERED = {
    "figure": ["fig(?:ure)?\\.?\\s*N\\b", "第\\s*N\\s*张?图", "图\\s*N\\b"],
    "table": ["table\\.?\\s*N\\b", "第\\s*N\\s*表", "表\\s*N\\b"],
    "equation": ["eq(?:uation)?\\.?\\s*N\\b", "formula\\s*N\\b", "(?:公式|式)\\s*N\\b", "[(（]\\s*N\\s*[)）]", "\\\\tag\\{\\s*N\\s*\\}"],
    **{kind: [f"{kind}\\.?\\s*N\\b", f"{LABELS[kind][1]}\\s*N\\b"] for kind in ("theorem", "lemma", "definition", "proposition", "corollary")},
}
#: The terms of the field, how a prompt and a document show them, and the bonuses: (wanted and there, wanted but the rival alone is there).
WANTED = {
    "single_shot": "单曝光|单次曝光|single[- ]shot|single exposure|snapshot", "single_pixel": "单像素|single[- ]pixel", "single_photon": "单光子|single photon|spad|sns|nanowire",
    "compressive": "压缩|compressive", "spectral": "光谱|spectral",
}
SHOWN = {"single_shot": "single[- ]shot|single exposure|snapshot", "single_pixel": "single[- ]pixel", "single_photon": "single[- ]photon|spad|sns|nanowire", "compressive": "compressive", "spectral": "spectral"}
BONUS = {"single_shot": 2.4, "single_pixel": 2.2, "single_photon": 2.0, "spectral": 0.9, "compressive": 0.6}
MISSING = {"spectral": -0.6, "compressive": -0.3}
RIVALS = [("single_shot", "single_pixel", -2.8), ("single_pixel", "single_shot", -1.6), ("single_pixel", "single_photon", -2.0), ("single_photon", "single_pixel", -1.6)]
#: Prompts about code, about the field, about an attached image, and about documents.
CODE = "\\bhello\\s*world\\b|\\brandom\\b|\\bcode\\b|\\bpython\\b|\\bjavascript\\b|\\bjs\\b|\\bjava\\b|\\bc\\+\\+|\\bcpp\\b|\\bfunction\\b|\\bscript\\b|\\bdebug\\b|\\bbug\\b|随机数|函数|脚本|代码|调试|报错"
ACADEMIC = "\\breference\\b|\\bcitation\\b|\\bpaper\\b|\\bpdf\\b|\\bdoi\\b|\\bequation\\b|\\bderive\\b|\\bgaussian splatting\\b|\\b3dgs\\b|\\bsingle[- ]pixel\\b|\\bsingle[- ]photon\\b|\\bcompressive\\b|\\bspectral\\b|\\boptics?\\b|\\bimaging\\b|\\bdetector\\b|参考文献|引用|论文|文献|公式|推导|单像素|单光子|压缩|光谱|光学|成像|探测器|高斯泼溅"
IMAGE = "\\b(?:this|the) (?:image|figure)\\b|\\blook at (?:the )?(?:image|figure)\\b|\\b(?:describe|explain|caption) (?:this )?(?:image|figure)\\b|\\bwhat is in (?:this )?(?:image|figure)\\b|\\bwhat does (?:this )?(?:image|figure) say\\b|这张图|这个图|这幅图|看图|看下图|解释.*图|这图写了啥|这图写了什么|这图什么意思|描述.*图|概括.*图|图里写了什么"
DOCUMENT = "\\bpaper\\b|\\bpdf\\b|\\bsection\\b|\\bchapter\\b|\\bcitation\\b|\\breference\\b|论文|文献|章节|引用|出自哪篇|哪个章节"
INTENTS = {
    "references": "参考文献|引用|cite|citation|reference|bibliography",
    "method": "怎么|如何|怎样|方法|实现|步骤|流程|原理|机制|算法|模型|编码|采样|掩膜|推导|公式|\\bhow\\b|\\bmethods?\\b|\\bapproach\\b|\\bimplement(?:ation)?\\b|\\balgorithm\\b|\\bmodel\\b|\\bequation\\b|\\bderive\\b",
    "result": "结果|性能|指标|对比|比较|实验|消融|准确率|误差|提升|\\bresults?\\b|\\bperformance\\b|\\bmetric\\b|\\bevaluation\\b|\\bcompare\\b|\\bablation\\b|\\bbenchmark\\b",
    "limitation": "局限|限制|不足|失效|失败|未来工作|讨论|结论|\\blimitations?\\b|\\bfailure\\b|\\bfuture work\\b|\\bdiscussion\\b|\\bconclusion\\b",
    "background": "是什么|定义|含义|概念|背景|综述|介绍|\\bwhat is\\b|\\bdefinition\\b|\\bbackground\\b|\\boverview\\b|\\bintro(?:duction)?\\b",
}
PREFERRED = [
    ("参考文献|引用|cite|citation|reference", "references bibliography"),
    ("是什么|定义|含义|概念|what is|definition", "abstract introduction overview background"),
    ("编码|掩膜|码|pattern|mask|sampling|coded|coding|hadamard|fourier|dmd|metamaterial|multiplex", "method approach model coding encoding pattern mask sampling implementation"),
    ("公式|推导|证明|算法|方法|实现|derive|equation|method|approach|model", "method approach model algorithm theory"),
    ("实验|结果|指标|性能|对比|消融|experiment|result|evaluation|ablation|baseline|compare", "experiment results evaluation implementation setup"),
]
PREFERRED_ELSE = "method approach model experiment results introduction"
MANY_PAPERS = "\\b(?:which|what)\\s+(?:other\\s+)?papers\\b|\\bother\\s+papers\\b|papers in (?:my|your) library|有?哪些文章|有?哪几篇文章|哪些论文|哪几篇论文|哪些文献|哪几篇文献"
ONE_PAPER = "\\b(?:which|what)\\s+paper\\b|哪篇文章|哪篇论文|哪篇文献"
ACTIONS = [
    ("compare", "\\b(?:compare|compares|compared|comparison|versus|vs)\\b|比较|对比"),
    ("define", "\\b(?:defin(?:e|es|ed|ition)|what\\s+is|introduced?\\s+as)\\b|定义|是什么"),
    ("discuss", "\\b(?:discuss(?:es|ed)?|mention(?:s|ed)?|cover(?:s|ed)?|address(?:es|ed)?|describe[sd]?)\\b|提到|提及|讨论|涉及|介绍"),
]
TOPICS = ["(?i)(?:提到了?|提及了?|讨论了?|涉及了?|定义了?)\\s*(.+?)(?:[，。？?]|$)", "(?i)(?:mention(?:s|ed)?|discuss(?:es|ed)?|defines?d?)\\s+(.+?)(?:[?.,]|$)"]
SECTIONS = [
    ("discussion", "\\bdiscussion\\b"), ("limitations", "\\blimitations?\\b"), ("future_work", "\\bfuture\\s+(?:work|directions?|extensions?)\\b"), ("conclusion", "\\bconclusions?\\b"),
    ("methods", "\\b(?:methods?|methodology)\\b"), ("results", "\\bresults?\\b"), ("introduction", "\\bintroduction\\b"), ("acquisition_strategy", "\\bacquisition(?:\\s+and\\s+image\\s+reconstruction)?\\s+strateg"),
    ("abstract", "\\babstract\\b"), ("references", "\\b(?:references?|reference\\s+list|works?\\s+cited|bibliography)\\b"),
]
#: Words that say nothing about a document, and the questions whose object is a focus phrase.
STOP = ("paper", "pdf", "article", "figure", "fig", "table", "equation", "eq", "formula", "theorem", "lemma", "definition", "proposition", "corollary", "图", "表", "公式", "定理", "引理", "定义", "命题", "推论", "文章", "论文", "这篇", "这个", "什么", "讲了", "讲的", "内容")
_VERBS = "(?:discuss(?:es|ed)?|mention(?:s|ed)?|cover(?:s|ed)?|address(?:es|ed)?|describe(?:s|d)?|use(?:s|d)?|introduce(?:s|d)?|define(?:s|d)?|compare(?:s|d)?)"
FOCUS = [
    "(?i)\\bwhere\\s+(?:in\\s+the\\s+[^?.!,]{1,80}\\s+)?is\\s+(.+?)\\s+(?:discussed|mentioned|defined|introduced)\\b",
    f"(?i)\\b(?:which|what)\\s+(?:other\\s+)?papers?[^?.!]{{0,120}}?\\b{_VERBS}\\s+(.+?)(?:[?.!]|$)",
    f"(?i)\\bbesides\\s+this\\s+paper[^?.!]{{0,120}}?\\b{_VERBS}\\s+(.+?)(?:[?.!]|$)",
]
QUOTED = "[\"“”‘’]([^\"“”‘’]{2,120})[\"“”‘’]"
COMPARES = "(?i)\\b(?:compare|compares|compared|comparison|versus|vs)\\b"
DEFINES = "(?i)\\b(?:defin(?:e|es|ed|ition)|what\\s+is|introduced?\\s+as)\\b"
EXPLAINS = "(?i)\\b(?:defin(?:e|es|ed|ition)|refers?\\s+to|introduced?\\s+as|is\\s+defined\\s+as)\\b"
#: Ends of Chinese questions, and the words between which their phrases stand.
SUFFIXES = ("是什么", "是啥", "是什么意思", "怎么做", "怎么", "如何", "为什么", "是否", "可以吗", "可以", "以及", "原理", "原因")
GLUE = "[的与和及以并而或，。；、]"


def roman(x: Column | str) -> Column:
    """The value of Roman letters in any number: a letter counts against the number where a larger one stands to its right."""
    table = F.create_map(*[F.lit(v) for kv in ROMAN.items() for v in kv])
    values = F.transform(F.split(F.lower(_c(x)), ""), lambda c: table[c])
    signed = F.transform(values, lambda v, i: F.when(v < F.array_max(F.slice(values, i + 2, 64)), -v).otherwise(v))
    return F.when(F.lower(_c(x)).rlike("^[ivxlcdm]+$"), F.aggregate(signed, F.lit(0), lambda s, v: s + v))


def chinese(x: Column | str) -> Column:
    """Chinese numerals up to 99: a digit, 十 alone, and digits before or behind 十."""
    x = _c(x)
    table = F.create_map(*[F.lit(v) for kv in CHINESE.items() for v in kv])
    left, right = F.split(x, "十", 2)[0], F.get(F.split(x, "十", 2), F.lit(1))
    composed = F.when(left == "", 10 + F.coalesce(table[right], F.lit(0))).otherwise(table[left] * 10 + F.when(right == "", 0).otherwise(table[right]))
    return F.when(F.length(x) == 1, table[x]).when(x.contains("十"), composed)


def numeral(x: Column | str) -> Column:
    """A number in Arabic, Roman or Chinese numerals."""
    x = F.trim(_c(x))
    return F.when(x.rlike("^\\d+$"), x.try_cast("int")).otherwise(F.coalesce(roman(x), chinese(x)))


def anchor(x: Column | str) -> Column:
    """Struct of kind and number: the first pattern of ANCHORS with a number above 0."""
    found = [(kind, numeral(F.nullif(F.regexp_extract(_c(x), pattern, 1), F.lit("")))) for kind, pattern in ANCHORS]
    return F.coalesce(*[F.when(n > 0, F.struct(F.lit(kind).alias("kind"), n.alias("number"))) for kind, n in found])


def _numbered(kind: Column, number: Column, most: int | None = None) -> Column:
    """The pattern of an anchor's number in a text, all its forms as one."""
    table = F.create_map(*[F.lit(v) for k, forms in NUMBERED.items() for v in (k, "(?i)" + "|".join(forms))])
    return F.replace(table[kind], F.lit("N"), number.cast("string"))


def anchor_bonus(text: Column, kind: Column, number: Column) -> Column:
    """12 for the anchor itself, 2 for a label of its kind, 1.2 for its number anywhere."""
    low = F.lower(text)
    labels = F.create_map(*[F.lit(v) for k, ls in LABELS.items() for v in (k, "|".join(ls))])
    score = F.when(F.regexp_like(low, _numbered(kind, number)), 12.0).otherwise(0.0) + F.when(F.regexp_like(low, labels[kind]), 2.0).otherwise(0.0) + F.when(low.contains(number.cast("string")), 1.2).otherwise(0.0)
    return F.when(kind.isNotNull() & (low != ""), score).otherwise(0.0)


def anchor_hits(text: Column, kind: Column, number: Column) -> Column:
    """40 and 12 for each place of the anchor in a text, 8 more where the text starts like a caption; null without a place."""
    n = F.regexp_count(text, _numbered(kind, number))
    caption = F.ltrim(F.lower(text)).rlike("^(?:fig\\.|figure|图|table|表|equation|theorem|lemma|definition|proposition|corollary|定理|引理|定义|命题|推论)")
    return F.when(n > 0, 40 + 12 * n + F.when(caption, 8).otherwise(0)).cast("double")


def term_bonus(prompt: Column, body: Column) -> Column:
    """For each term that the prompt wants: a bonus where the body shows it, a malus where only a rival of it is shown (or, for some, nothing)."""
    want = {t: match_text(prompt).rlike(p) for t, p in WANTED.items()}
    has = {t: match_text(body).rlike(p) for t, p in SHOWN.items()}
    total = F.lit(0.0)
    for t, plus in BONUS.items():
        total = total + F.when(want[t] & has[t], plus).when(want[t], MISSING.get(t, 0.0)).otherwise(0.0)
    for t, rival, minus in RIVALS:
        total = total + F.when(want[t] & has[rival] & ~has[t], minus).otherwise(0.0)
    return total


def bypasses_retrieval(x: Column | str) -> Column:
    """About code and not about the field."""
    return F.lower(_c(x)).rlike(CODE) & ~F.lower(_c(x)).rlike(ACADEMIC)


def image_first(x: Column | str) -> Column:
    """Empty, or about the attached image and no document."""
    low = F.trim(F.lower(_c(x)))
    return (low == "") | (low.rlike(IMAGE) & ~low.rlike(DOCUMENT))


def intent_flags(x: Column | str) -> dict[str, Column]:
    return {name: F.lower(_c(x)).rlike(pattern) for name, pattern in INTENTS.items()}


def preferred_sections(x: Column | str) -> Column:
    out = None
    for pattern, names in PREFERRED:
        hit = F.lower(_c(x)).rlike(pattern)
        out = F.when(hit, names) if out is None else out.when(hit, names)
    return F.split(out.otherwise(PREFERRED_ELSE), " ")


def paper_scope(x: Column | str) -> Column:
    """Whether a prompt asks for many papers or for one."""
    low = F.lower(_c(x))
    return F.when(low.rlike(MANY_PAPERS), "list").when(low.rlike(ONE_PAPER), "single").otherwise("")


def focus_action(x: Column | str) -> Column:
    low, out = F.lower(_c(x)), None
    for name, pattern in ACTIONS:
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return out.otherwise("")


def topic(x: Column | str) -> Column:
    """What papers are asked to mention, discuss or define."""
    found = [F.nullif(F.trim(F.regexp_replace(F.regexp_extract(_c(x), p, 1), "\\s+", " ")), F.lit("")) for p in TOPICS]
    return F.coalesce(*found, F.lit(""))


def section_targets(x: Column | str) -> Column:
    return F.filter(F.array(*[F.when(F.lower(_c(x)).rlike(p), name) for name, p in SECTIONS]), lambda s: s.isNotNull())


def box_numbers(x: Column | str) -> Column:
    return F.array_distinct(_all(x, "(?i)\\bbox\\s*(\\d{1,3})\\b", 1).cast("array<int>"))


def informative_tokens(x: Column | str, least: int = 3) -> Column:
    return F.filter(tokens(match_text(x)), lambda t: (F.length(t) >= least) & ~t.isin(*STOP))


def focus_phrases(x: Column | str, most: int = 6) -> Column:
    """Quoted spans and the objects of the FOCUS questions (apart at 'and' where the prompt compares), normalised; informative ones, each once."""
    objects = F.filter(F.array(*[F.nullif(F.regexp_extract(_c(x), p, 1), F.lit("")) for p in FOCUS]), lambda s: s.isNotNull())
    parts = F.when(_c(x).rlike(COMPARES), F.flatten(F.transform(objects, lambda o: F.concat(F.array(o), F.split(o, "(?i)\\b(?:and|versus|vs)\\b"))))).otherwise(objects)
    raw = F.transform(F.concat(_all(x, QUOTED, 1), parts), lambda s: F.trim(match_text(F.regexp_replace(F.regexp_replace(s, "(?i)^(?:the|a|an)\\s+", ""), "[?,;:!()\\[\\]{}\"“”‘’]", " "))))

    def informative(s: Column) -> Column:
        own = informative_tokens(s)
        first = F.get(own, F.lit(0))
        return (F.size(own) >= 2) | ((F.size(own) == 1) & ((F.length(first) >= 6) | first.rlike("\\d")))

    return F.slice(F.array_distinct(F.filter(raw, informative)), 1, most)


def phrase_on_surface(phrase: Column, surface: Column) -> Column:
    """Whether a normalised phrase stands in a text, or two of its long words do."""
    low = match_text(surface)
    words = F.array_distinct(informative_tokens(phrase, 4))
    return low.contains(phrase) | ((F.size(words) >= 2) & (F.size(F.array_intersect(words, tokens(low))) >= 2))


def focus_score(prompt: Column, title: Column, body: Column) -> Column:
    """How much a document is about a prompt's focus phrases: 5.2 for each in the title, 4.1 in the body, 1.8 more where the prompt asks for
    a definition and the body gives one, 4.6 where it compares two and so does the document, 1.2 for a single phrase; at most 18."""
    phrases = focus_phrases(prompt)
    state = F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("matched"))
    defined = prompt.rlike(DEFINES) & body.rlike(EXPLAINS)

    def step(s: Column, p: Column) -> Column:
        t, b = phrase_on_surface(p, title), phrase_on_surface(p, body)
        score = s["score"] + F.when(t, 5.2).otherwise(0.0) + F.when(b, 4.1).otherwise(0.0) + F.when(b & defined, 1.8).otherwise(0.0)
        return F.struct(score.alias("score"), (s["matched"] + F.when(t | b, 1).otherwise(0)).alias("matched"))

    found = F.aggregate(phrases, state, step)
    compared = prompt.rlike(COMPARES) & (title.rlike(COMPARES) | body.rlike(COMPARES)) & (found["matched"] >= 2)
    total = found["score"] + F.when(compared, 4.6).otherwise(0.0) + F.when((found["matched"] >= 1) & (F.size(phrases) == 1), 1.2).otherwise(0.0)
    return F.least(total, F.lit(18.0))


def source_match(prompt: Column, name: Column) -> Column:
    """How much a prompt names a file: 9 or 8 for its name, 2 to 5 for three common words or more, 2 more where they are most of the name."""
    low, stem = F.lower(prompt), F.regexp_replace(name, "\\.[^.]*$", "")
    named = F.when((name != "") & low.contains(F.lower(name)), F.when(F.lower(name).endswith(".pdf"), 9.0).otherwise(8.0)).when((stem != "") & low.contains(F.lower(stem)), 8.0).otherwise(0.0)
    own = F.array_distinct(informative_tokens(F.concat_ws(" ", name, stem)))
    common = F.size(F.array_intersect(own, informative_tokens(prompt)))
    words = F.when(common >= 3, 2.0 + F.least(F.lit(3.0), 0.6 * common) + F.when(common / F.size(own) >= 0.55, 2.0).otherwise(0.0)).otherwise(0.0)
    return named + words


def keywords(x: Column | str, most: int = 4) -> Column:
    """Chinese phrases without question ends, apart at glue words; without any, the Latin words of three letters or more."""
    ends = "(?:" + "|".join(sorted(SUFFIXES, key=len, reverse=True)) + ")$"
    phrases = F.flatten(F.transform(_all(x, "[\\x{4e00}-\\x{9fff}]{2,}"), lambda p: F.split(F.regexp_replace(p, ends, ""), GLUE)))
    phrases = F.array_distinct(F.filter(phrases, lambda p: F.length(p) >= 2))
    words = F.array_distinct(F.filter(tokens(x), lambda t: F.length(t) > 2))
    return F.slice(F.when(F.size(phrases) > 0, phrases).otherwise(words), 1, most)

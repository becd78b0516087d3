"""Questions about a vacancy, answered with its own words: an intent, the field it asks for, and quotes.

Intents are ordered patterns in one conditional; quotes are statements of the vacancy, filtered by the intent's
pattern. Nothing is composed that the source does not say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions import skills as sk
from ..functions import text as tx
from . import ranking

# Intents in their order, the pattern of the question, and that of the statements which answer it.
_FORMAT = r"удал[её]н|remote|офис|office|гибрид|hybrid|работ\w*\s+из\s+дома|work(?:ing)?\s+from\s+home|on[\s-]?site"
_LOAD = r"(?:полн|частичн|неполн)\w*\s+занятост|(?:part|full)[\s\-–—‑]*time|(?:полн|неполн)\w*\s+(?:рабоч\w*\s+)?д[её]н"
_SCHEDULE = r"график|schedule|\b\d+\s*(?:час\w*|hours?)\b|\b[1-7]\s*/\s*[1-7]\b"
INTENTS = (
    ("improvement", r"улучш|повыс|поднят|improv|increase|strengthen|добавить.*резюме|дописать|чего.*не хватает", None),
    ("score", r"балл|скор|score|оценк|ранж|рейтинг|почему.*(?:ниже|выше|низк|высок)", None),
    ("salary", r"зарплат|оклад|оплат|salary|compensation|pay\b|жалақы", None),
    ("location", r"город|локац|где.*работ|location|city|where.*(?:job|work)|қала", None),
    ("employment", rf"{_FORMAT}|{_LOAD}|график|занятост|employment|schedule|формат.*работ", rf"{_FORMAT}|{_LOAD}|{_SCHEDULE}"),
    ("languages", r"язык(?!.*программир)|languages?(?!.*programming)|английск|русск|казахск|english|kazakh|қазақ|ағылшын", r"английск|русск|казахск|english|russian|kazakh|қазақ|ағылшын|\b[ABC][12]\b"),
    ("education", r"образован|диплом|education|degree|бакалавр|магистр", r"образован|диплом|education|degree|bachelor|master|бакалавр|магистр"),
    ("experience", r"стаж|опыт|experience|seniority|junior|middle|senior|сколько.*лет|years", None),
    ("requirements", r"требован|навык|стек|technolog|requirements|skills|stack|что.*(?:знать|уметь)|нужен|нужн[аоы]", None),
    ("company", r"кто.*работодател|какая\s+(?:это\s+)?компани|название\s+компани|which company|employer", None),
    ("overview", r"(?:расскажи|опиши).*?(?:ваканси|позици)|tell.*(?:job|vacancy|role)|describe.*(?:job|vacancy|position)", None),
)
FIELDS = {"salary": "salary", "location": "city", "experience": "experience", "company": "company", "requirements": "requirements", "overview": "title"}
_IGNORED = "какой какая какие почему можно вакансии вакансия работа what which about this that with есть".split()


def intent(question: Column, lexicon=None) -> Column:
    """The first intent whose pattern the question has; a named skill asks for requirements; else 'source'."""
    q = tx.normalised(question)
    out = None
    for name, pattern, _ in INTENTS:
        on = q.rlike("(?iU)" + pattern)
        if name == "requirements":
            on = on | (F.size(sk.extract(question) if lexicon is None else sk.extract(question, lexicon)) > 0)
        out = F.when(on, name) if out is None else out.when(on, name)
    return out.otherwise("source")


def _having(pattern: str) -> Column:
    return F.filter("parts", lambda p: p.rlike(pattern))


def answers(questions: DataFrame, lexicon=None) -> DataFrame:
    """topic, value (the vacancy's field, null if it has none) and quotes for rows of question and vacancy fields.

    A question of no intent is answered by statements that share a word with it; without any its topic is 'unknown'.
    """
    rows = questions.withColumn("topic", intent(F.col("question"), lexicon))
    rows = rows.withColumn("parts", tx.statements(F.concat_ws("\n", "title", "requirements", "responsibilities", "text")))
    words = F.array_except(F.regexp_extract_all(tx.normalised("question"), F.lit(r"(?U)[\w+#.]{4,}"), F.lit(0)), F.array(*[F.lit(w) for w in _IGNORED]))
    rows = rows.withColumn("words", words)
    value = None
    for topic, field in FIELDS.items():
        v = F.nullif(F.trim(F.coalesce(F.col(field), F.lit(""))), F.lit(""))
        value = F.when(F.col("topic") == topic, v) if value is None else value.when(F.col("topic") == topic, v)
    quotes = None
    for topic, _, pattern in INTENTS:
        if pattern:
            own = F.slice(_having("(?iU)" + pattern), 1, 3)
            quotes = F.when(F.col("topic") == topic, own) if quotes is None else quotes.when(F.col("topic") == topic, own)
    shared = F.slice(F.filter("parts", lambda p: F.arrays_overlap(F.col("words"), F.regexp_extract_all(F.lower(p), F.lit(r"(?U)[\w+#.]{4,}"), F.lit(0)))), 1, 2)
    quotes = quotes.when(F.col("topic") == "source", shared).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("value", value).withColumn("quotes", F.transform(quotes, lambda s: F.left(s, F.lit(600))))
    topic = F.when((F.col("topic") == "source") & (F.size("quotes") == 0), "unknown").otherwise(F.col("topic"))
    return rows.withColumn("topic", topic).drop("parts", "words")


#: What an answer can advise, by a short name that results carry.
ADVICE = {
    "choose_resume": "Choose a resume: a vacancy alone has no score and nothing to improve.",
    "compare": "Compare the resume with the vacancy first.",
    "name_skills": "Name the technologies you have worked with, and what for.",
    "describe_tasks": "Describe one or two projects: the task, your part, the technologies and the result.",
    "separate_practice": "Tell practice from what you know of or are only learning.",
    "add_context": "Add the context of your work: duties, projects and your own part.",
    "show_missing": "If you have such experience, describe a task with the skills that the text does not confirm. Add none that you lack.",
    "state_role_years": "State how long you worked in this role, apart from all your years.",
    "check_years": "Check the years taken from the text, and discuss with HR whether fewer are enough.",
}
SHORT_RESUME = 180
LEAST_TERM = 1e-12


def _advice(rows: DataFrame) -> Column:
    """Names of ADVICE that hold for a resume against a vacancy, in the order of the table; unknown years are not zero years."""
    chosen, compared = F.col("resume_text").isNotNull(), F.col("score").isNotNull()
    own = tx.professional_text("resume_text")
    acts = F.exists(tx.statements(own), lambda s: tx.positive(s) & s.rlike("(?iU)" + lx.WORK_ACTION))
    holds = {
        "choose_resume": ~chosen,
        "compare": chosen & ~compared,
        "name_skills": chosen & (F.coalesce(F.size("skills"), F.lit(0)) <= 0),
        "describe_tasks": chosen & ~F.coalesce(acts, F.lit(False)),
        "separate_practice": chosen & (F.coalesce(F.size("weak_skills"), F.lit(0)) > 0),
        "add_context": chosen & (F.length(own) < SHORT_RESUME),
        "show_missing": chosen & compared & (F.size("lacking") > 0),
        "state_role_years": chosen & compared & F.col("relevant_years").isNull() & (F.col("required_years") > 0),
        "check_years": chosen & compared & (F.col("relevant_years") < F.col("required_years")),
    }
    given = F.array_compact(F.array(*[F.when(F.coalesce(holds[name], F.lit(False)), F.lit(name)) for name in ADVICE]))
    return F.when(F.size(given) == 0, F.array(F.lit("describe_tasks"))).otherwise(given)


def score_answers(questions: DataFrame, lexicon=None) -> DataFrame:
    """Answers to questions about a score and how to raise it (R22): topic, value, largest, lacking, advice.

    Rows hold the question, the resume (``resume_text``, null if none is chosen; ``skills`` that it shows, ``weak_skills`` that it
    only mentions) and its comparison with a vacancy (``score``, null if there is none; ``contributions`` of (feature, value,
    contribution); ``required``, ``missing`` and ``uncertain`` skills; ``relevant_years`` and ``required_years``, null if unknown).

    value is the score with its sign, largest the four largest contributions that are not zero, lacking the required skills that
    are missing or uncertain, in order, advice names of ADVICE. All four are null for other topics; without a resume or a
    comparison a score question gets only its first step as advice. Null arrays count as empty. Other columns stay.
    """
    rows = questions.withColumn("topic", intent(F.col("question"), lexicon))
    some = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    lacking = F.array_sort(F.array_intersect(F.array_distinct(F.concat(some("missing"), some("uncertain"))), some("required")))
    rows = rows.withColumn("lacking", lacking)
    rows = rows.withColumn("advice", _advice(rows))
    known = F.col("resume_text").isNotNull() & F.col("score").isNotNull()
    asks, raises = F.col("topic") == "score", F.col("topic") == "improvement"
    largest = ranking.top_contributions(F.filter("contributions", lambda c: F.abs(c["contribution"]) > LEAST_TERM))
    first_step = F.when(F.col("resume_text").isNull(), "choose_resume").when(F.col("score").isNull(), "compare")
    return (
        rows.withColumn("value", F.when(asks & known, tx.number_text("score", 3, True)))
        .withColumn("largest", F.when(asks & known, largest))
        .withColumn("advice", F.when(raises, F.when(F.col("resume_text").isNull(), F.array(F.lit("choose_resume"))).otherwise(F.col("advice"))).when(asks, F.array_compact(F.array(first_step))))
        .withColumn("lacking", F.when((asks | raises) & known, F.col("lacking")))
    )

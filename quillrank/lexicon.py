"""Fixed vocabularies and patterns of the matching engine.

The patterns name roles, tasks and levels in Russian and English. Skill lexicons are large and
change with the market, so they are a parameter everywhere: a mapping of each canonical name to its
aliases. :data:`SKILLS` is a small one to start with; :func:`read_lexicon` reads others from a table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

Lexicon = Mapping[str, Sequence[str]]

# The fifteen signals of a pair, in the order of model files.
FEATURES = (
    "skill_coverage", "skill_jaccard", "task_coverage", "role_compatibility", "seniority_compatibility",
    "experience_compatibility", "education_level_compatibility", "education_field_coverage",
    "language_compatibility", "mandatory_skill_confirmation", "industry_coverage",
    "communication_confirmation", "required_skill_coverage", "demonstrated_skill_coverage",
    "relevant_experience_fulfillment",
)

# Patterns of professional roles.
ROLES = {
    "backend": r"backend|back.end|б[эе]к[эе]нд|(?:java|python|c#|\.net|golang|node\.?js)\s+(?:developer|разработчик)",
    "frontend": r"front[ ._-]?end|фронт.?енд|фронт.?энд",
    "fullstack": r"full[ -]?stack|фул[ -]?ст[еэ]к",
    "data_engineering": r"data\s+engineer(?:ing)?|инженер\w*\s+(?:по\s+)?данн|(?:etl|dwh)\s+(?:developer|engineer)|разработчик\w*\s+(?:etl|dwh)",
    "data_analysis": r"data\s+analyst|аналитик\w*\s+данных|bi\s+(?:analyst|developer)|business intelligence",
    "data_science": r"data\s+scien(?:ce|tist)|machine learning|ml\s+(?:engineer|research)",
    "business_analysis": r"business analyst|бизнес.?аналитик",
    "qa": r"\bqa\b|quality assurance|тестировщик|automation testing|инженер по тестированию",
    "devops": r"devops|site reliability|\bsre\b",
    "support": r"help\s*desk|it\s+(?:specialist|специалист)|it.специалист|техподдерж|системн\w*\s+администр|system\s+admin",
    "design": r"ui\s*[/&-]\s*ux|ux\s*[/&-]\s*ui|\bdesigner\b|дизайнер",
    "security": r"security|кибербезопас|информационн\w*\s+безопас",
    "sales": r"\bsales\b|продаж|business development|business relations",
    "marketing": r"marketing|маркетинг|монетизац|monetization",
    "finance": r"финанс\w*\s+аналитик|finance analyst|бухгалтер|accountant",
    "product": r"product\s+(?:manager|owner)|продукт\w*\s+менеджер|менеджер\s+продукт",
    "project": r"project\s+(?:manager|coordinator)|operations manager|руководител\w*\s+проект|менеджер\w*\s+проект",
    "teaching": r"преподавател|репетитор|\bteacher\b|\btutor\b|lecturer",
    "telecom": r"радио|телеком|\bррл\b|telecommunicat|network engineer",
    "software": r"software\s+(?:engineer|developer)|разработчик|программист|\bdeveloper\b",
}
# Patterns of tasks.
TASKS = {
    "data_pipelines": r"\betl\b|\belt\b|data\s+pipelines?|data\s+warehouse|\bdwh\b|поток\w*\s+данных|трансформац\w*\s+данных|хранилищ\w*\s+данных",
    "backend_systems": r"backend\s+(?:systems?|services?)|microservices?|микросервис|серверн\w*\s+(?:систем|сервис)|б[эе]кенд\s+сервис",
    "frontend_interfaces": r"front.end\s+(?:interfaces?|applications?)|user\s+interfaces?|клиентск\w*\s+интерфейс|пользовательск\w*\s+интерфейс",
    "ml_models": r"train\w*\s+(?:ml\s+)?models?|model\s+training|обучени\w*\s+модел|нейронн\w*\s+сет|neural\s+networks?",
    "code": r"программир|разработк|programming|software development|write.*code|coding",
    "testing": r"тестирован|тест.план|testing|test.plans?|unit.tests?|\bqa\b",
    "design": r"дизайн|прототип|prototyp|wirefram|ui/ux|interface design",
    "data": r"анализ.*данн|data analys|\beda\b|визуализац|visualization|статистик|statistics",
    "documents": r"документац|documentation|technical writing|технич\w*\s+документ",
    "sales": r"продаж|\bsales\b|commercial proposal|коммерческ\w*\s+предлож",
    "clients": r"клиент|заказчик|client|customer|crm|партнер|партнёр|partner",
    "contracts": r"договор|contract",
    "leadership": r"руковод|управлен.*команд|lead.*team|team.*lead|supervis",
    "planning": r"планирован|project management|проект|budget|бюджет|roadmap|mvp",
    "tender": r"тендер|tender|procurement|закуп",
    "support": r"поддержк|support|troubleshoot|обслуживан",
    "training": r"обучен|препода|training|teaching|learning.plan",
    "marketing": r"маркетинг|marketing|реклам|advertis|promotion|продвижен",
    "deployment": r"deploy|ci/cd|production|разверт|развёрт",
    "networks": r"tcp/ip|маршрутиз|routing|subnet|ethernet|сетев|радио|telecom",
}
# Tools that confirm a skill but no profession, and the tasks that stand for a role.
COMMON_SKILLS = frozenset({"git", "github", "gitlab", "rest api", "agile", "scrum", "jira", "confluence"})
TASK_ROLES = {
    "data_pipelines": "data_engineering", "backend_systems": "backend", "frontend_interfaces": "frontend",
    "ml_models": "data_science", "networks": "telecom",
}
# Patterns of industries, fields of education, degrees and seniority.
INDUSTRIES = {
    "finance": r"banking|finance|financial|accounting|банк|финанс|бухгалтер|\bopex\b",
    "education": r"education|образован|обучен|university|университет",
    "logistics": r"logistics|delivery|логистик|доставк|qazpost",
    "ecommerce": r"e.commerce|ecommerce|электронн\w*\s+коммерц|интернет.магазин",
    "mining": r"mining|горнодобыв|горноруд|горной\s+промышлен",
    "pharma": r"pharma|фармацевт|лекарств",
    "telecom": r"telecom|телеком|спутников|связи|связь",
}
EDUCATION_FIELDS = {
    "computing": r"computer science|software|information systems|информационн\w*\s+систем|программн\w*\s+обеспеч|\bit\b|\bит\b",
    "engineering": r"engineering|инженер|technical|техническ",
    "telecom": r"radio|радио|telecom|телеком|электроник|electronics",
    "business": r"business|бизнес|administration|enterprise management|менеджмент",
    "finance": r"finance|финанс|accounting|бухгалтер",
    "math": r"mathematics|математик|statistics|статистик",
}
DEGREES = (
    (1, r"college|колледж|среднее специальное"),
    (2, r"\bbachelor\b|бакалавр|высшее образование|university degree|graduate degree"),
    (3, r"\bmaster\b|магистр|магистратур"),
    (4, r"\bph\.?d\b|doctorate|доктор наук"),
)
SENIORITY = (
    (0, r"\bintern\b|internship|стаж[её]р"),
    (1, r"\bjunior\b|\bjun\b|младший|джун"),
    (2, r"\bmiddle\b|\bmid.level\b|мидл"),
    (3, r"\bsenior\b|\bsr\b|старший|сеньор"),
    (4, r"\b(?:team|tech|technical)\s+lead\b|\blead\s+(?:developer|engineer|designer)\b|\bhead of\b|ведущий|руководитель"),
)
# Languages and the words of their levels, best first.
LANGUAGES = {"english": r"english|английск\w*|ағылшын\w*", "russian": r"russian|русск\w*|орыс\w*", "kazakh": r"kazakh|казахск\w*|қазақ\w*"}
CEFR = {"a1": 1, "a2": 2, "b1": 3, "b2": 4, "c1": 5, "c2": 6}
LEVEL_WORDS = ((6, r"native|родно[йя]|ана тілі"), (5, r"fluent|advanced|свободн|в совершенстве|еркін"), (4, r"upper.intermediate|good|хорош"), (3, r"intermediate|средний|орташа"))
LEVEL_NEAR = r"\b[abc][12]\b|native|родно|fluent|advanced|свобод|intermediate|good|хорош|еркін"
# Wishes, work verbs, and what makes a statement no claim.
OPTIONAL = r"желател\w*|будет\s+плюсом|преимуществ\w*|необязател\w*|\boptional\b|\bpreferred\b|\bnice[ -]to[ -]have\b|\ba plus\b"
WORK_ACTION = (
    r"\b(?:built|build|developed|implemented|created|maintained|deployed|designed|optimized|integrated|automated|tested|delivered|migrated|used)\b|"
    r"разработ\w*|созда\w*|внедр\w*|поддержива\w*|настро\w*|разверн\w*|разв[её]рн\w*|оптимизир\w*|автоматизир\w*|интегрир\w*|тестирова\w*"
)
NO_CLAIM = (
    r"не работал|нет опыта|опыт\w*[^.!?;]{0,100}\bнет\b|never worked|no experience|never (?:built|used|created|developed)|"
    r"\b(?:(?:have|has|had|did|do)\s+not|haven't|hasn't|hadn't|didn't|don't)\s+(?:use[ds]?|work(?:ed)?|build|built|create[ds]?|develop(?:ed)?)\b|"
    r"не (?:строил|разрабатывал|создавал|делал|занимался)|not (?:a |an )?(?:data|backend|frontend)|"
    r"хочу стать|планирую стать|хочу изучить|планирую изучить|хочу освоить|изучаю|осваиваю|"
    r"aspiring|want to (?:be|become|learn)|looking to (?:become|learn)|plan to learn|"
    r"^\s*(?:currently\s+)?learning\b|\bi am learning\b|\bcurrently learning\b"
)
WEAK_BEFORE = (
    r"(?:\b(?:learning|learn|beginner(?: in)?|basic(?: knowledge of)?|no experience(?: with| in)?|never used)\b|изучаю|изучить|осваиваю|освоить|"
    r"базов\w*(?: знани\w*)?|не работал(?: с| в)?|не использовал|нет опыта(?: работы)?(?: с| в)?|не знаю|знаком(?:ство)? с)\s*$|"
    r"(?:(?:(?:have|has|had|did|do)\s+not|haven't|hasn't|hadn't|didn't|don't|never)\s+(?:use[ds]?|work(?:ed)?(?:\s+(?:with|in))?)|"
    r"never (?:built|created|developed)|не (?:строил|разрабатывал|создавал|делал|занимался))[^.!?;]{0,100}$"
)
WEAK_AFTER = r"^\s*[:—–-]?\s*(?:только\s+)?(?:изучаю|осваиваю|не работал|не использовал|не знаю|нет опыта|\b(?:beginner|basic|learning|no experience|never used)\b)"
DENIED_AFTER = (
    r"^\s*[:—–-]?\s*(?:(?:is|was)\s+(?:a[n]?\s+)?(?:tool|technology|framework|language|database)\s+(?:(?:that|which)\s+)?)?"
    r"(?:(?:i|we|he|she)\s+)?(?:(?:have|has|had|did|do)\s+not|haven't|hasn't|hadn't|didn't|don't|never)\s+(?:use[ds]?|work(?:ed)?|built|created|developed)\b|"
    r"^\s*[:—–-]?\s*(?:(?:опыт\w*|практик\w*)[^.!?;]{0,50})?\bнет\b"
)
# Direct denials of use, and what keeps a language level from being a claim.
NEGATIVE_BEFORE = (
    r"(?:не\s+(?:использовал\w*|использую|работал\w*|работаю|знаю|применял\w*|применяю)|нет\s+опыта(?:\s+работы)?|\bno\s+(?:work\s+)?experience|\bnever\s+(?:used|worked|applied)|"
    r"\b(?:(?:have|has|had|did|do)\s+not|haven't|hasn't|hadn't|didn't|don't)\s+(?:use[ds]?|work(?:ed)?|apply|applied))\s*(?:(?:с|в|with|in|of)\s*)?(?:[,/&]|\b(?:and|or|и|или)\b|\s)*$"
)
NEGATIVE_AFTER = (
    r"^\s*[:—–-]?\s*(?:не\s+(?:использовал\w*|использую|работал\w*|работаю|знаю|применял\w*|применяю)|нет\s+опыта|(?:опыт\w*|практик\w*)[^.!?;]{0,50}\bнет\b|\bno\s+experience|\bnever\s+(?:used|worked|applied)|"
    r"(?:(?:is|was)\s+(?:a[n]?\s+)?(?:tool|technology|framework|language|database)\s+(?:(?:that|which)\s+)?)?(?:(?:i|we|he|she)\s+)?"
    r"(?:(?:have|has|had|did|do)\s+not|haven't|hasn't|hadn't|didn't|don't|never)\s+(?:use[ds]?|work(?:ed)?|apply|applied))"
)
PRACTICE_BEFORE, NONE_AFTER = r"опыт\w*|практик\w*", r"^\s*[:—–-]?\s*нет\b"
#: Rules of denial: which words before a mention are looked at, what they say, and what the words after it say; an empty pattern asks for nothing.
DENIALS = (("near", "", NEGATIVE_AFTER), ("near", PRACTICE_BEFORE, NONE_AFTER), ("list", NEGATIVE_BEFORE, ""))
# Headings and words of musts, the end of a heading, what is cut off round a mark of a wish, sentences of requirements.
MUST_HEADING = r"(?:обязател\w*|требован\w*|must[ -]have|required)\s*[:：]"
MUST, MANDATORY = r"\brequired\b|\bmust\b|обязател\w*", r"обязател|mandatory|required|must"
HEADING_END, SENTENCE_CUT = r"[:：]\s*$", r"[;\n]|\.(?:\s|$)"
EDGE, EDGE_AFTER = " ,;:—–-", "()."
# Words of communication, asked for and shown; studies that have not ended.
TALK = r"communicat|коммуник|переговор|презентац"
TALK_SHOWN = rf"{TALK}|presentations"
STUDIES = r"\bstudent\b|\bстудент(?:ка)?\b|in progress|обучаюсь"
# Roles that are several at once, and kinds of roles.
ROLE_PARTS = {"fullstack": frozenset({"backend", "frontend"})}
ROLE_KINDS = {"software": frozenset({"backend", "frontend", "fullstack"})}
# What joins the names of a list; verbs that a comma closes off from what follows.
LIST_END, LIST_BEGIN = r"(?:\s|[,/&]|\b(?:and|or|и|или)\b)+$", r"^(?:\s|[,/&]|\b(?:and|or|и|или)\b)+"
CLOSED_BY_COMMA = r"(?:не знаю|не работал|не использовал|изучаю|осваиваю|never used|no experience)\s*,\s*$"
# Signs that a duration is of a whole career, before and after it; how many characters of either side count,
# and how far a role may stand from the duration it has.
OVERALL_BEFORE = r"(?:общ(?:ий|его)\s+(?:опыт|стаж)|(?:total|overall)\s+(?:work\s+)?experience)\s*[:—–-]?\s*$"
OVERALL_AFTER = r"^\s*(?:(?:of\s+)?(?:total|overall)\b|(?:of\s+)?experience\s*,?\s*including|(?:общего\s+)?стажа\s*,?\s*из них)"
TOTAL_BEFORE = r"(?:total|общий|опыт работы|work experience)\s*[:—–-]?\s*$"
SIDE_BEFORE, SIDE_AFTER, ROLE_REACH, LEVEL_REACH = 45, 55, 60, 80
ROLE_NOUN = r"(?:\s+(?:developer|engineer|разработчик|инженер))?"
MONTHS = r"months?|месяц"
LANGUAGE_WISH = r"\b(?:want|hope|plan|aim)\s+to\b|\btarget\b|\bgoal\b|\baspir\w*|\b(?:learning|studying)\b|хочу|планирую|намерен|изучаю|осваиваю|\bцель\b|целев\w*|желаем\w*"
LANGUAGE_DENIAL = r"не\s+(?:владею|знаю|говорю|достиг\w*)|\b(?:cannot|can't|don't|do not)\s+(?:speak|know|use)\b|\b(?:no|without)\s+(?:knowledge|proficiency)\b"
# Where a text falls into statements; lines that say nothing of a profession.
STATEMENT_CUT = (
    r"\n+|(?<=[.!?;])\s+|,?\s+(?:но|однако|but|however)\s+|"
    r",?\s+and\s+(?=(?:(?:i|we)\s+)?(?:(?:have|has|had|did|do)\s+not|haven't|hasn't|hadn't|didn't|don't|never)\s+(?:use|used|work|worked|build|built))"
)
TEMPLATE_LINE = r"describe (?:what|the)|опишите (?:что|задачу)"
PERSONAL_LINE = (
    r"гражданств|nationality|citizenship|date of birth|\bdob\b|родил|\b(?:женщина|мужчина)\b|\b(?:male|female)\b|marital|семейное положение|"
    r"проживает|резюме обновлено|resume updated|история общения|preferred.*contact"
)
CONTACT_PARTS = (
    r"(?:https?://|www\.|t\.me/)\S+|[\w.+-]+@[\w.-]+\.\w+",
    r"(?i)(?:github|linkedin|phone|email|телефон|почта)\s*:\s*(?:\[[A-Z]+\]|\S+)?",
    r"\[(?:PHONE|EMAIL|URL|CONTACT|NAME)\]",
)
# Durations and totals.
DURATION = r"(?P<years>\d+(?:[.,]\d+)?)\s*(?P<unit>years?|лет|года?|months?|месяц\w*)(?:\s+(?P<months>\d+)\s*(?:месяц\w*|months?))?"
TOTAL_YEARS = (
    r"(?:опыт работы|work experience)\s*[:—–-]?\s*(\d+(?:[.,]\d+)?)\s*(?:лет|год\w*|years?)(?:\s+(\d+)\s*(?:месяц\w*|months?))?",
    r"(?:with|over)\s+(\d+(?:\.\d+)?)\+?\s+years?\s+(?:of\s+)?experience",
)
NO_EXPERIENCE = r"нет опыта|без опыта|no experience"
# Weights of the declared baseline and its constants elsewhere.
BASELINE_WEIGHTS = {"ml1_hybrid": 0.25, "required_skills": 0.30, "demonstrated_skills": 0.15, "professional_profile": 0.15, "relevant_experience": 0.10, "languages": 0.05}
ALPHA, CONFIDENCE_TARGET, NEAR_DUPLICATE = 0.4, 5, 0.85

# Soft skills of span annotation.
SOFT_SKILLS = {
    "analytical thinking": ["analytical thinking"],
    "attention to detail": ["attention to detail", "detail-oriented", "detail oriented"],
    "fast learning": ["fast learning ability", "fast learner", "quick learner"],
    "problem solving": ["problem-solving", "problem solving"],
    "teamwork": ["teamwork", "teamwork and collaboration"],
    "collaboration": ["collaboration", "collaborative"],
    "communication": ["communication", "communication skills", "clear communication"],
    "responsibility": ["responsibility", "responsible"],
    "discipline": ["discipline", "disciplined"],
    "time management": ["time management"],
    "adaptability": ["adaptability", "adaptable"],
    "leadership": ["leadership", "leadership skills"],
}
# Words that say nothing, for frequency reports.
STOP_WORDS = (
    "и в во на с со по для из от до за к ко о об при или а но что как это мы вы наш ваш его ее их не да нет быть "
    "работа работы работать опыт опыта знание знания знаний умение умения требования обязанности условия "
    "лет года год будет является также которые который которая компания компании команде команда разработка разработки "
    "the a an and or of to in for with on at from by as is are be will we you our your this that have has experience "
    "work working knowledge skills skill requirements responsibilities company team development "
    "және мен үшін бұл бар жұмыс жұмысқа тәжірибе талаптар"
).split()

# Profile families of vacancy titles, the first whose pattern is found; and how many of 50 reviewed pairs have each label.
PROFILE_FAMILIES = (
    ("data-engineering", r"data.?engineer|инженер.*данн|etl|dwh"), ("data-science", r"data.?scien|machine.?learning|\bml\b|искусствен"),
    ("data-analysis", r"data.?anal|аналитик|business.?intelligence|\bbi\b"), ("fullstack", r"full.?stack|фулст"),
    ("frontend", r"front|react|angular|vue|версталь"), ("quality", r"\bqa\b|тестир|quality|test.?engineer"),
    ("infrastructure", r"devops|sre|системн|админ|network|cloud|сетев"), ("security", r"security|безопас|кибер"),
    ("mobile", r"mobile|android|ios|мобиль"), ("design", r"design|дизайн|ux|ui"),
    ("backend", r"back|python|java|php|c#|\.net|разработ|developer|programmer"),
)
OTHER_FAMILY = "other-it"
REVIEW_WEIGHTS = {0: 1, 1: 21, 2: 21, 3: 7}

SKILLS: Lexicon = {
    "python": [], "java": [], "javascript": ["js"], "typescript": ["ts"], "c++": ["cpp"], "c#": ["c sharp"], "go": ["golang"],
    "sql": [], "postgresql": ["postgres"], "mysql": [], "mongodb": ["mongo"], "redis": [], "docker": [], "kubernetes": ["k8s"],
    "git": [], "github": [], "gitlab": [], "linux": [], "airflow": ["apache airflow"], "spark": ["apache spark", "pyspark"],
    "kafka": ["apache kafka"], "django": [], "flask": [], "fastapi": [], "spring": ["spring boot"], "react": ["react.js", "reactjs"],
    "vue": ["vue.js", "vuejs"], "angular": [], "node.js": ["nodejs"], "html": ["html5"], "css": ["css3"], "rest api": ["restful api", "rest apis"],
    "machine learning": ["машинное обучение"], "pandas": [], "numpy": [], "pytorch": [], "tensorflow": [], "etl": ["etl pipelines"],
    "power bi": ["powerbi"], "tableau": [], "excel": ["ms excel"], "jira": [], "agile": [], "scrum": [], "aws": ["amazon web services"],
    "azure": [], "ci/cd": [], "figma": [], "tcp/ip": [], "1c": ["1с"],
}


def read_lexicon(rows: DataFrame) -> dict[str, list[str]]:
    """A lexicon from a table of (canonical, alias); a dimension that fits the driver by its nature, not by the corpus."""
    found: dict[str, list[str]] = {}
    for r in rows.select("canonical", "alias").orderBy("canonical", "alias").toLocalIterator():
        own = found.setdefault(r.canonical, [])
        if r.alias and r.alias != r.canonical:
            own.append(r.alias)
    return found

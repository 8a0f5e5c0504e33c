"""Expressions on job postings and wage filings: technical or not, country, names of skills, yearly wages."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.text import annualise, parse_number

# Patterns of titles that are never technical, always, never without such a one, and else.
VETO_TITLES = (
    r"\bai\s+trainer\b", r"\bai\s+tutor\b", r"\bsearch\s+quality\s+rater\b", r"sales\s*&\s*service\s+consultant", r"sales\s+and\s+service\s+consultant",
    r"\bdata\s+annotat", r"\bbrand\s+ambassador\b", r"\bcrowd\s*work\b",
)
STRONG_TITLES = (
    r"software", r"\bswe\b", r"\bsde\b", r"developer", r"\bdev\b", r"programmer", r"\bfront[\s-]?end\b", r"\bback[\s-]?end\b", r"full[\s-]?stack",
    r"\bweb\b", r"\bmobile\b", r"\bios\b", r"\bandroid\b", r"\bdata\s+(engineer|scientist|analyst|architect)", r"\bdata\b.*\b(engineer|scien|analy|platform|pipeline)",
    r"machine\s+learning", r"\bml\b", r"\bml[\s-]?ops\b", r"\bai\b", r"\bartificial\s+intelligence\b", r"deep\s+learning", r"\bnlp\b", r"\bllm\b",
    r"computer\s+vision", r"\bgen[\s-]?ai\b", r"dev[\s-]?ops", r"\bsre\b", r"site\s+reliability", r"platform\s+engineer", r"\bcloud\b", r"\baws\b", r"\bazure\b",
    r"\bgcp\b", r"kubernetes", r"\bk8s\b", r"infrastructure\s+engineer", r"systems?\s+engineer", r"\bsysadmin\b", r"security\s+engineer", r"cyber[\s-]?security",
    r"\binfosec\b", r"\bappsec\b", r"penetration\s+test", r"\bpentest\b", r"security\s+analyst", r"\bqa\b", r"\bsdet\b", r"quality\s+(engineer|assurance)",
    r"test\s+(engineer|automation)", r"\bnetwork(ing)?\s+engineer", r"network\s+administrat", r"\bembedded\b", r"firmware", r"\bfpga\b", r"\basic\b", r"\bvlsi\b",
    r"\belectrical\s+engineer", r"\belectronics?\s+engineer", r"hardware\s+engineer", r"\bdatabase\s+(engineer|administrat)", r"\bdba\b",
    r"solutions?\s+(engineer|architect)", r"sales\s+engineer", r"forward[\s-]?deployed", r"technical\s+(account|program|product|project|lead|writer|support|consultant|architect|specialist)",
    r"\bprompt\s+engineer", r"\bblockchain\b", r"\bweb3\b", r"\bsmart\s+contract\b", r"\bgame\s+(developer|engineer|programmer)", r"\bgraphics\s+engineer\b",
    r"\bsystems?\s+administrator\b", r"\bit\s+(support|engineer|administrator|technician|specialist|analyst|manager|operations)", r"\bhelp\s?desk\b",
    r"\bdesktop\s+support\b", r"\btech(nology)?\s+(lead|manager|director)\b", r"\brobotics?\b", r"\bautomation\s+engineer\b", r"\bcontrols?\s+engineer\b",
    r"\bmechatronics?\b", r"\bbioinformatics?\b", r"\bgis\b\s|\bgis\s+(analyst|developer|specialist)", r"\bux\b", r"\bui\b", r"user\s+experience", r"product\s+design",
    r"\bux/?ui\b", r"design\s+system", r"interaction\s+design", r"\bscrum\s+master\b", r"\bagile\s+coach\b", r"engineering\s+(manager|director|lead)",
    r"\bvp\s+(of\s+)?engineering\b", r"head\s+of\s+(engineering|data|product|design|platform|security|infrastructure)",
    r"director\s+of\s+(engineering|data|product|design|platform|security|technology)", r"\bproduct\s+(owner|lead|director)\b",
)
NEGATIVE_TITLES = (
    r"\bnurse\b", r"\bnursing\b", r"\brn\b", r"\blpn\b", r"\bcna\b", r"clinical", r"\bphysician\b", r"\bdoctor\b", r"\bsurgeon\b", r"\bpharmac", r"\bdentist\b",
    r"\bcaregiver\b", r"\btherapist\b", r"\bmedical\s+assistant\b", r"\bphlebotom", r"\bpatient\b", r"\bhealthcare\s+(assistant|aide)", r"\bveterinar", r"\bretail\b",
    r"\bcashier\b", r"\bsales\s+associate\b", r"\bstore\s+(manager|associate)", r"\bmerchandis", r"\bstock\b", r"\bwarehouse\b", r"\bforklift\b", r"\bpicker\b",
    r"\bdriver\b", r"\bdelivery\b", r"\bchauffeur\b", r"\bcourier\b", r"\btrucking\b", r"\blogistics\b", r"\bsupply\s+chain\b", r"\bprocurement\b", r"\bcook\b",
    r"\bchef\b", r"\bbarista\b", r"\bserver\b\s|\bwaiter\b", r"\bwaitress\b", r"\bkitchen\b", r"\bfood\s+(service|prep)", r"\brestaurant\b", r"\bhospitality\b",
    r"\bteacher\b", r"\bteaching\b", r"\btutor\b", r"\bprofessor\b", r"\blecturer\b", r"\beducator\b", r"\bfaculty\b", r"\bcoach\b\s|\bbabysitter\b", r"\bchildcare\b",
    r"\baccount\s+(executive|manager|director)\b", r"\bsales\s+(manager|director|representative|rep|consultant|specialist|executive|advisor|agent|lead|development)\b",
    r"\bsales\s+development\s+representative\b", r"\binstitutional\s+sales\b", r"\bbusiness\s+development\b", r"\bsdr\b", r"\bbdr\b", r"\binside\s+sales\b",
    r"\bmarketing\b", r"\bbrand\b", r"\bsocial\s+media\b", r"\bcopywriter\b", r"\bcontent\s+(writer|creator|strategist)\b", r"\bseo\b\s", r"\bpublic\s+relations\b",
    r"\bcommunications?\s+(manager|specialist|coordinator)\b", r"\bjournalist\b", r"\breporter\b", r"\blawyer\b", r"\battorney\b", r"\bcounsel\b", r"\blegal\b",
    r"\bparalegal\b", r"\bcompliance\b", r"\bregulatory\b", r"\baccountant\b", r"\baccounting\b", r"\bbookkeep", r"\bauditor\b", r"\btax\b", r"\bpayroll\b",
    r"\bfinanc(e|ial)\s+(analyst|advisor|manager|controller|planner)\b", r"\bunderwrit", r"\bactuary\b", r"\bteller\b", r"\bbanker\b", r"\binvestment\s+banking\b",
    r"\brecruit", r"\btalent\s+acquisition\b", r"\bhuman\s+resources?\b", r"\bhr\s+(manager|generalist|business)\b", r"\badministrative\s+assistant\b",
    r"\breceptionist\b", r"\bexecutive\s+assistant\b", r"\boffice\s+(manager|administrator)\b", r"\bsecretary\b", r"\bclerk\b", r"\bdata\s+entry\b",
    r"\bcustomer\s+service\b", r"\bcall\s+center\b", r"\bcustomer\s+success\b", r"\bcustomer\s+support\b", r"\bcleaner\b", r"\bjanitor\b", r"\bhousekeep",
    r"\bsecurity\s+guard\b", r"\bsecurity\s+officer\b", r"\bconstruction\b", r"\bplumber\b", r"\bcarpenter\b", r"\bwelder\b", r"\bpainter\b", r"\blandscap",
    r"\bmaintenance\s+(technician|worker)\b", r"\bmechanic\b", r"\bsales\b.*\bassociate\b", r"\breal\s+estate\b", r"\binsurance\s+agent\b", r"\bpsycholog",
    r"\bsocial\s+worker\b", r"\bcounsel(or|ing)\b", r"\bphotograph", r"\bvideograph", r"\bgraphic\s+design", r"\billustrator\b",
)
SOFT_TITLES = (
    r"\bengineer\b", r"\barchitect\b", r"\banalyst\b", r"\bproduct\s+manager\b", r"\btechnical\b", r"\btechnolog", r"\bdigital\b", r"\bsystems?\b", r"\bplatform\b",
    r"\bdesigner\b", r"\bresearch\s+scientist\b", r"\bresearcher\b", r"\bintegration\b", r"\bapi\b", r"\bsaas\b", r"\bcomputing\b",
)
# Names of countries, their cities, states of the US, and other names of skills.
COUNTRY_WORDS = {
    "IN": ("india",), "US": ("united states", "usa", "u.s.", "u.s.a."), "GB": ("united kingdom", "uk", "u.k.", "england", "scotland", "wales", "britain", "great britain"),
    "CA": ("canada",), "AU": ("australia",), "SG": ("singapore",), "DE": ("germany", "deutschland"),
}
CITIES = {
    "IN": ("bangalore", "bengaluru", "mumbai", "delhi", "new delhi", "gurgaon", "gurugram", "hyderabad", "pune", "chennai", "noida", "kolkata", "ahmedabad", "jaipur"),
    "GB": ("london", "manchester", "edinburgh", "cambridge", "bristol", "leeds", "glasgow", "oxford", "birmingham"),
    "CA": ("toronto", "vancouver", "montreal", "ottawa", "calgary", "waterloo", "kitchener", "edmonton"),
    "AU": ("sydney", "melbourne", "brisbane", "perth", "canberra", "adelaide"),
    "SG": ("singapore",),
    "DE": ("berlin", "munich", "münchen", "muenchen", "hamburg", "frankfurt", "cologne", "köln", "koeln", "stuttgart", "düsseldorf", "duesseldorf", "karlsruhe"),
    "US": ("san francisco", "new york", "seattle", "austin", "boston", "chicago", "los angeles", "denver", "atlanta", "palo alto", "mountain view", "sunnyvale", "san jose", "washington", "remote us", "remote - us"),
}
US_STATES = (
    "al", "ak", "az", "ar", "ca", "co", "ct", "de", "fl", "ga", "hi", "id", "il", "in", "ia", "ks", "ky", "la", "me", "md", "ma", "mi", "mn", "ms", "mo", "mt", "ne", "nv",
    "nh", "nj", "nm", "ny", "nc", "nd", "oh", "ok", "or", "pa", "ri", "sc", "sd", "tn", "tx", "ut", "vt", "va", "wa", "wv", "wi", "wy", "dc",
)
SKILL_NAMES = {
    "nodejs": "node", "node.js": "node", "postgresql": "postgres", "postgre": "postgres", "k8s": "kubernetes", "amazon web services": "aws", "google cloud platform": "gcp",
    "golang": "go", "js": "javascript", "ts": "typescript", "py": "python", "ms sql": "sql server", "rest api": "rest", "restful": "rest", "ci cd": "ci/cd", "cicd": "ci/cd",
}
# The axes of a profile and their skills, and the skills of a text that names none.
AXES = {
    "Backend depth": ("System Design", "Go", "Python", "SQL", "Kubernetes", "Observability", "Java", "Rust"),
    "Cloud / Infra": ("AWS", "Terraform", "Kubernetes", "Docker", "Linux", "CI/CD", "Cost Optimization", "Networking", "Observability"),
    "Data & ML": ("Python", "Machine Learning", "PyTorch", "TensorFlow", "Statistics", "SQL", "Data Modeling", "Spark", "dbt", "LLM / GenAI", "Vector DBs", "Airflow"),
    "System design": ("System Design", "Kubernetes", "Observability", "GraphQL"),
    "Leadership": ("Stakeholder Mgmt", "Roadmapping"),
    "Frontend": ("React", "TypeScript", "JavaScript", "Design Systems", "Figma", "GraphQL"),
}
FLOOR_SKILLS = ("SQL", "Python")


def any_of(patterns: Sequence[str]) -> str:
    """One pattern of several, whatever the case of letters."""
    return "(?i)" + "|".join(patterns)


def is_technical(title: Column, description: Column) -> Column:
    """Whether a posting is technical: by its title, and where that says nothing, by strong words of the whole description.

    In this order: a veto, a strong word, a negative one, a soft one of the title, a strong word of the description.
    Nulls are empty texts; two of them are not technical.
    """
    title, description = F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))
    strong = any_of(STRONG_TITLES)
    by_title = F.when(title.rlike(any_of(VETO_TITLES)), False).when(title.rlike(strong), True).when(title.rlike(any_of(NEGATIVE_TITLES)), False).when(title.rlike(any_of(SOFT_TITLES)), True)
    return by_title.otherwise(description.rlike(strong))


def country_of(location: Column, hint: Column | None = None) -> Column:
    """One of seven countries: the hint if it is one, else by a country's name, a city, or a state of the US at the end; null for others."""
    low = F.lower(F.btrim(F.coalesce(location, F.lit(""))))
    code = F.upper(F.btrim(F.lit(None).cast("string") if hint is None else hint))
    found = F.when(code.isin(*COUNTRY_WORDS), code)
    for country, words in COUNTRY_WORDS.items():
        found = found.when(low.rlike(r"\b(" + "|".join(map(re.escape, words)) + r")\b"), country)
    for country, cities in CITIES.items():
        found = found.when(low.rlike("|".join(cities)), country)
    return found.when(F.btrim(F.element_at(F.split(low, "[,/|]"), -1)).isin(*US_STATES), "US")


def skill_key(c: Column) -> Column:
    """The common form of a skill's name: lower case, without a part in brackets, by its usual other names; blank for null."""
    low = F.regexp_replace(F.lower(F.btrim(F.coalesce(c, F.lit("")))), "’", "'")
    bare = F.coalesce(F.nullif(F.btrim(F.substring_index(low, "(", 1)), F.lit("")), low)
    named = F.coalesce(F.create_map(*[F.lit(x) for pair in SKILL_NAMES.items() for x in pair])[bare], bare)
    spaced = F.when(named == "ci/cd", "ci / cd").otherwise(F.regexp_replace(named, "\\s+", " "))
    return F.btrim(spaced, F.lit(" .,-"))


def is_certified(status: Column) -> Column:
    """Whether a filing's status begins with ``certified``; a withdrawn one counts too."""
    return F.lower(F.btrim(F.coalesce(status, F.lit("")))).startswith("certified")


def yearly_wage(c: Column, unit: Column) -> Column:
    """The yearly wage of a text by its unit, whatever the unit's case and outer blanks; null for none and for 0 and less."""
    yearly = annualise(parse_number(c), F.lower(F.btrim(F.coalesce(unit, F.lit("")))))
    return F.nullif(F.greatest(yearly, F.lit(0.0)), F.lit(0.0))


def skills_named(text: Column, known: Sequence[str]) -> Column:
    """The known skills that a text names as whole words, by name; two common ones if it names none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.array_compact(F.array(*[F.when(low.rlike(r"\b" + re.escape(s.lower()) + r"\b"), s) for s in sorted(set(known))]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, FLOOR_SKILLS)))


def axis_scores(skills: Column) -> Column:
    """A map from each axis to 30 and 16 for each of its skills, within 20 and 98."""
    score = lambda own: F.least(30 + 16 * F.size(F.array_intersect(skills, F.array(*map(F.lit, own)))), F.lit(98))
    return F.create_map(*[x for axis, own in AXES.items() for x in (F.lit(axis), score(own).cast("long"))])

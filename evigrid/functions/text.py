"""Text expressions: sentences, compliance rules, numbers and citations, addresses and question types. Native expressions throughout."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases and patterns of the compliance rules.
HEDGES = ["would", "may", "could", "modeled", "projected", "is mapped", "1% annual chance", "1 percent annual chance", "any given year", "during a base flood", "in modeled scenarios", "in the modeled", "expected", "anticipated", "estimated"]
WILL_FLOOD = r"\b(will flood|is going to flood|is flooding|will be inundated|is inundated|this address floods|the address floods)\b"
REASSURANCE = r"(\bno risk\b|\bzero risk\b|\bcompletely safe\b|\bnothing to worry about\b|\bguaranteed dry\b|\bsafe from flooding\b|\bwon'?t flood\b|\bno chance of flood)"
HUNDRED_YEAR, ONE_PERCENT = r"\b100[- ]year flood\b", r"(1\s*%\s*annual chance|1 percent annual chance|any given year)"
FLOOD_MAP, YEAR = r"\b(fema flood map|firm|flood insurance rate map|flood zone)\b", r"\b(19|20)\d{2}\b"
UNCALIBRATED, PERCENT = ["probably", "fairly likely", "good chance", "decent chance", "pretty likely", "kinda likely"], r"\b\d+(\.\d+)?\s*%"
PROJECTION = r"\b(project(?:ed|ion)|forecast|scenario|model(?:ed)? for|nowcast)\b"
HORIZON = (
    r"(by\s+(?:19|20)\d{2}|in\s+(?:19|20)\d{2}|(?:19|20)\d{2}\s+(?:slr|sea[- ]level rise|baseline|scenario)"
    r"|(?:next|over\s+the\s+next|past|last|previous)\s+\d+(?:\.\d+)?\s*[- ]?\s*(?:year|month|week|day|hour|minute)s?"
    r"|\d+(?:\.\d+)?\s*[- ]?\s*(?:year|month|week|day|hour|minute)s?\s+(?:ahead|out|horizon|window|forecast|nowcast|cadence|projection|outlook)"
    r"|short[- ]term|medium[- ]term|long[- ]term|near[- ]term)"
)
ABSENCE = r"(\bno\b[^.!?]{0,40}\b(available|provided|present|data)\b|\b(not|isn'?t|is\s+not)\s+(?:yet\s+)?(?:available|provided|reflected)\b|\bcannot\s+be\s+(?:reported|detailed|provided)\b)"
SCOPE = ["flood-exposure briefing", "flood exposure briefing", "this briefing", "this flood briefing"]
DISCLAIMER = ["not a substitute", "informational only", "not a flood certificate", "not an elevation certificate", "not an insurance determination", "does not constitute", "consult a licensed"]
AUTOMATION = ["automated", "machine-generated", "algorithmically", "generated by"]
GAP = ["offline", "unavailable", "not available", "could not", "missing", "data gap", "not evaluated"]
UNRELATED = r"\b(car accident|automobile accident|driving|lightning strike|airplane crash|plane crash|shark attack|lottery)\b"
UNITS = "m|ft|km|mi|mm|cm|in|sq ?m|sq ?ft|inches|feet"
PRECISION = rf"\b\d+\.\d{{3,}}\s*({UNITS})\b"
QUANTITY, CITATION = rf"\b\d[\d,]*(\.\d+)?\s*({UNITS}|%)", r"\[[a-z][a-z0-9_]*\]"
NUMBER, TRIVIAL = r"\b(-?\d[\d,]*(?:\.\d+)?)\b", ["0", "1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "100", "311", "911", "211"]
SEPARATOR = "\u001e"


@dataclass(frozen=True)
class Rule:
    """A sentence rule fails where `bad` matches a sentence and no exemption does; a document rule passes where `need` is met."""

    name: str
    bad: str = ""
    unless: tuple[str, ...] = ()
    unless_any: tuple[str, ...] = ()
    bad_any: tuple[str, ...] = ()
    need_any: tuple[str, ...] = ()


RULES = [
    Rule("no_bare_flood_claim", bad=WILL_FLOOD, unless_any=tuple(HEDGES)),
    Rule("no_false_reassurance", bad=REASSURANCE),
    Rule("map_has_year", bad=FLOOD_MAP, unless=(YEAR,)),
    Rule("no_uncalibrated_probability", bad=PERCENT, bad_any=tuple(UNCALIBRATED)),
    Rule("projection_has_horizon", bad=PROJECTION, unless=(HORIZON, ABSENCE)),
    Rule("no_unrelated_comparison", bad=UNRELATED),
    Rule("no_false_precision", bad=PRECISION),
    Rule("quantity_is_cited", bad=QUANTITY, unless=(CITATION,)),
    Rule("scope_declared", need_any=tuple(SCOPE)),
    Rule("disclaimer_present", need_any=tuple(DISCLAIMER)),
    Rule("automation_disclosed", need_any=tuple(AUTOMATION)),
]


def sentences(text: Column) -> Column:
    """Sentences of a text: cut after . ! or ? before white space; empty ones are left out."""
    # A bare F.trim would take the sentence's number, which transform hands over as well, for the characters to trim.
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+", -1), lambda s: F.trim(s)), lambda s: s != "")


def contains_any(text: Column, phrases) -> Column:
    out = F.lit(False)
    for phrase in phrases:
        out = out | text.contains(phrase)
    return out


def breaks(rule: Rule, low: Column) -> Column:
    """Whether a sentence, in lower case, breaks a rule."""
    out = low.rlike(rule.bad)
    if rule.bad_any:
        out = out & contains_any(low, rule.bad_any)
    for pattern in rule.unless:
        out = out & ~low.rlike(pattern)
    return out & ~contains_any(low, rule.unless_any) if rule.unless_any else out


def failed_sentences(rule: Rule, text: Column) -> Column:
    """The sentences that break a rule."""
    return F.filter(sentences(text), lambda s: breaks(rule, F.lower(s)))


def failed_rules(rules: list[Rule], text: Column) -> Column:
    """The names of the rules that a text breaks, in one pass over its sentences."""
    by_sentence = [r for r in rules if r.bad]

    def add(state: Column, low: Column) -> Column:
        out = state
        for i, rule in enumerate(by_sentence):
            out = out.bitwiseOR(F.when(breaks(rule, low), F.lit(1 << i)).otherwise(F.lit(0)))
        return out

    named = lambda mask: F.array_compact(F.array(*[F.when(mask.bitwiseAND(1 << i) != 0, F.lit(r.name)) for i, r in enumerate(by_sentence)]))
    found = F.aggregate(sentences(F.lower(text)), F.lit(0), add, named)
    whole = F.array_compact(F.array(*[F.when(~passes(r, text), F.lit(r.name)) for r in rules if r.need_any]))
    return F.array_union(found, whole)


def passes(rule: Rule, text: Column) -> Column:
    """Whether a text keeps a rule."""
    if rule.need_any:
        return contains_any(F.lower(text), rule.need_any)
    return F.size(failed_sentences(rule, text)) == 0


def hundred_year_clarified(text: Column) -> Column:
    low = F.lower(text)
    return ~low.rlike(HUNDRED_YEAR) | low.rlike(ONE_PERCENT)


def gap_disclosed(text: Column, offline: Column) -> Column:
    """Sources that were offline call for a word on the gap."""
    return ~F.coalesce(offline, F.lit(False)) | contains_any(F.lower(text), GAP)


def numbers(text: Column) -> Column:
    """Number tokens of a text without bold marks and citations; well-known small ones are left out."""
    clean = F.regexp_replace(F.regexp_replace(text, r"\*\*", ""), r"(?i)\[[a-z0-9_]+\]", "")
    return F.filter(F.regexp_extract_all(clean, F.lit(NUMBER), F.lit(1)), lambda n: ~n.isin(TRIVIAL))


def in_sources(number: Column, sources: Column) -> Column:
    """Whether a number occurs in the sources: as written, without commas, or without trailing zeros."""
    plain = F.replace(number, F.lit(","), F.lit(""))
    short = F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    return sources.contains(number) | sources.contains(plain) | sources.contains(short)


def invented_numbers(text: Column, sources: Column) -> Column:
    return F.filter(numbers(text), lambda n: ~in_sources(n, sources))


def cited_ids(text: Column) -> Column:
    """Ids in square brackets, each once, in order of first use."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[([a-z][a-z0-9_]*)\]"), F.lit(1)))


def repaired_citations(text: Column, ids: list[str]) -> Column:
    """(id) becomes [id] where it names a source."""
    return F.regexp_replace(text, r"\((" + "|".join(ids) + r")\)", r"[$1]") if ids else text


def normalised_citations(text: Column) -> Column:
    return F.regexp_replace(text, r"\[doc_id\s*=\s*([a-z][a-z0-9_]*)\]", r"[$1]")


# Parts of a question that are not the address.
_TRAILING = r"(?i)[\s,]*(?:at\s+risk(?:\s+(?:of|for))?(?:\s+(?:flooding|flood|flooded))?|flood(?:ing|ed)?(?:\s+(?:risk|exposure|hazard))?|hazard\s+exposure)\s*\??\s*$"
_LEAD = r"(?i)^.*?\b(?:flood(?:ing)?|risk|hazard|briefing|report|exposure|assess(?:ment)?)\b[^,\d]*?\b(?:at|for|near|of|in|on|around)\s+"
_FILLER = r"(?i)^(?:please\s+|can\s+you\s+|could\s+you\s+|(?:what'?s?|what\s+is|how|is|are|show(?:\s+me)?|tell\s+me(?:\s+about)?|give\s+me|get\s+me|find|look\s*up|check|assess)\b\s*)+"


def address(query: Column) -> Column:
    """The address in a question: without trailing risk words and a leading clause or filler; the question where nothing is left."""
    whole = F.trim(F.coalesce(query, F.lit("")))
    s = F.trim(F.regexp_replace(whole, _TRAILING, ""))
    strip = lambda c: F.regexp_replace(c, r"^[ ,]+|[ ,]+$", "")
    led, filled = strip(F.regexp_replace(s, _LEAD, "")), strip(F.regexp_replace(s, _FILLER, ""))
    best = F.when(s.rlike(_LEAD) & (led != ""), led).when(filled != "", filled).otherwise(s)
    return F.when(best == "", whole).otherwise(best)


# Words of a question about an area rather than an address.
AREAS = r"(?i)\b(neighborhood|nta|district|coney island|hollis|red hook|brownsville|the bronx|harlem|lower east side|east village|williamsburg|astoria)\b"


def heuristic_intent(query: Column) -> Column:
    """What a question is about where no model reads it: an area if it names one, else an address."""
    return F.when(F.coalesce(query, F.lit("")).rlike(AREAS), "neighborhood").otherwise("single_address")


# Amounts of money and fiscal years, and their labels.
BACKSTOPS = {
    "dollar_amount": r"(?i)\$\s?[\d,]+(?:\.\d+)?\s*(?:million|billion|thousand|k|m|b)?",
    "date_range": r"(?i)\b(?:FY|fiscal year|fiscal years?)\s+\d{2,4}(?:[-–]\d{2,4})?\b",
}


def backstops(text: Column) -> Column:
    """label, text of the amounts and fiscal years in a text, each once whatever its case, the first spelling of it."""
    named = lambda label: lambda x: F.struct(F.lit(label).alias("label"), x.alias("text"))
    lists = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), named(label)) for label, p in BACKSTOPS.items()]

    def add(seen: Column, e: Column) -> Column:
        known = F.exists(seen, lambda k: (k.label == e.label) & (F.lower(k.text) == F.lower(e.text)))
        return F.when(known, seen).otherwise(F.array_append(seen, e))

    found = F.concat(*lists)
    return F.aggregate(found, F.slice(found, 1, 0), add)


def excerpt(text: Column, size: int = 240) -> Column:
    """The beginning of a text, with a mark where it goes on."""
    return F.concat(F.left(text, F.lit(size)), F.when(F.length(text) > size, "…").otherwise(""))


# Question types in order of precedence, and their patterns; the first type with a pattern that matches counts.
QUESTION_TYPES = [
    ("retrospective", [
        r"\b(would have|on (the )?date of|as of (the )?(date|day)|day before|prior to|before (Hurricane|Ida|Sandy|the storm)|"
        r"on (August|September|October|November|December|January|February|March|April|May|June|July) \d{1,2},? ?\d{4}|"
        r"time.?machine|retrospective|court (exhibit|testimony))\b",
    ]),
    ("emergency_response", [
        r"\b(just triggered|right now|next (few |six |\d+ )?hours?|in the next \d+|currently flooding|flood (warning|watch) is active|"
        r"sensor [A-Z]{2}-?\d+|live (alert|trigger))\b",
    ]),
    ("legal_disclosure", [
        r"\b(disclos(e|ure|ed)|RPL\s*§?\s*\d+|Property Condition Disclosure|§\s*462|§\s*231-?b|seller'?s? disclosure|landlord'?s? disclosure|"
        r"required to disclose|need to disclose)\b",
    ]),
    ("grant_evidence", [
        r"\b(vulnerability assessment|CDBG-?DR|HUD|BRIC|grant application|funding application|community resilience grant|"
        r"FEMA application|disaster recovery (application|funding))\b",
    ]),
    ("development_siting", [
        r"\b(what (are|is) (they|being) build(ing)?|new construction|under construction|active (construction|filing|project|permit)|"
        r"projects? (in progress|underway|planned)|architects?|siting check|pre.?design|DOB filing|developer)\b",
    ]),
    ("comparison", [
        r"\b(compare\b|comparison|\bvs\b|\bversus\b|head-?to-?head|\brank\s+the\s+top)\b",
        r"(?s)\bprioritize\b.{1,80}\bover\b",
        r"\bover\s+\w+(?:\s+\w+){0,3}\s+for\s+(hardening|investment)\b",
    ]),
    ("capital_planning", [
        r"\b(prioritiz(e|ation)|capital plan(ning)?|harden(ing|s)?|infrastructure investment|where (should|to) (we |the )(invest|prioritize|harden)|"
        r"MTA.+prioritize|DEP.+prioritize|protection envelope|outside (it|the protection)|resilien(ce|cy) project)\b",
    ]),
    ("habitability_decision", [
        r"\b(should I worry|should I (be|consider)|is (it|this) safe|can I (rent|live|move|raise (my )?kids?)|considering (renting|leasing|moving)|"
        r"(thinking about|planning to) (rent|lease|move|buy)|is (this|that|the landlord) true|landlord (says|claims|told)|"
        r"no flood history|just got a lease|new lease|signing a lease|\bworry\b)",
    ]),
    ("underwriting", [
        r"\b(underwrit(e|er|ing|able)|actuarial|loss history|insurabl[ey]|catastrophe (model|risk)|insurance (audit|memo|profile)|audit (chain|trail))\b",
    ]),
    ("journalism", [
        r"\b(reporter|journalist|newsroom|story|coverage|published?|publish (this|the))",
    ]),
]


def question_type(query: Column, intent: Column) -> Column:
    """The first question type with a pattern that matches, whatever the case; short neighbourhood questions are journalism."""
    whole = F.trim(query)
    out = F.when(query.isNull() | (whole == ""), "generic_exposure")
    for name, patterns in QUESTION_TYPES:
        hit = F.lit(False)
        for pattern in patterns:
            hit = hit | whole.rlike(f"(?i){pattern}")
        out = out.when(hit, name)
    return out.when((intent == "neighborhood") & (F.size(F.split(whole, r"\s+")) <= 3), "journalism").otherwise("generic_exposure")


def chunks(text: Column, size: int = 700) -> Column:
    """Chunks of whole sentences, filled greedily up to `size` characters; a longer sentence is a chunk by itself."""

    def add(state: Column, s: Column) -> Column:
        fits = (state.open == "") | (F.length(state.open) + 1 + F.length(s) <= size)
        longer = F.when(state.open == "", s).otherwise(F.concat(state.open, F.lit(" "), s))
        done = F.when(fits, state.done).otherwise(F.array_append(state.done, state.open))
        return F.struct(done.alias("done"), F.when(fits, longer).otherwise(s).alias("open"))

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    return F.aggregate(sentences(text), start, add, lambda state: F.when(state.open == "", state.done).otherwise(F.array_append(state.done, state.open)))


def normalised_name(name: Column) -> Column:
    """Lower-case letters only."""
    return F.regexp_replace(F.lower(name), "[^a-z]+", "")

"""A rule engine: every rule is a condition that yields a violation row; a registry holds named sets of rules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X

SEVERITIES = ["error", "warning", "info"]
#: Informal wordings, in lower case, that a formal text does without.
INFORMAL = [
    "a lot of", "lots of", "kind of", "sort of", "pretty much", "really", "stuff", "things", "gonna", "wanna",
    "can't", "won't", "don't", "isn't", "aren't", "wasn't", "weren't", "hasn't", "haven't", "shouldn't", "wouldn't", "couldn't", "didn't", "doesn't",
    "let's", "that's", "what's", "here's", "there's", "where's", "how's", "who's", "it's", "you're", "they're", "we're",
    "awesome", "cool", "guys", "etc.", "e.g.", "i.e.", "basically", "obviously", "actually", "anyway", "anyways", "plus", "tons of", "huge", "tiny", "big", "good", "bad", "nice", "okay", "ok",
]
#: Wordings that ask for a citation, and what one looks like.
CLAIMS = [
    "studies (show|indicate|suggest|demonstrate)", "research (shows|indicates|suggests|demonstrates)", "according to", "data (shows|indicates|suggests|demonstrates)",
    "evidence (shows|indicates|suggests|demonstrates)", "findings (show|indicate|suggest|demonstrate)", "results (show|indicate|suggest|demonstrate)", "analysis (shows|indicates|reveals)",
    r"[0-9]+\s*%", "statistics", "survey", "study", "report", "published", "discovered", "found that", "proven", "demonstrated",
]
CITED = [
    r"\([A-Z][a-zA-Z]+(?:\s+(?:et\s+al\.?|and|&)\s+[A-Z][a-zA-Z]+)*,?\s+\d{4}\)",
    r"\[[A-Z][a-zA-Z]+(?:\s+(?:et\s+al\.?|and|&)\s+[A-Z][a-zA-Z]+)*,?\s+\d{4}\]",
    r"\[\d+\]",
    r"\(\d+\)",
    r"<sup>\d+</sup>",
    r"\^\d+",
]
#: Academic transitions, and intensifiers that say little.
TRANSITIONS = [
    "furthermore", "moreover", "consequently", "therefore", "thus", "hence", "accordingly", "nevertheless", "nonetheless", "however",
    "conversely", "alternatively", "similarly", "likewise", "specifically", "particularly", "notably", "significantly", "importantly", "additionally",
]
VAGUE = ["very", "really", "quite", "rather", "somewhat"]
FIRST_PERSON = ["i", "me", "my", "mine", "we", "us", "our", "ours"]


@dataclass(frozen=True)
class Rule:
    """``broken`` makes the condition from the rule's settings; ``message`` may use them too."""

    rule_id: str
    broken: Callable[[dict], Column]
    message: str
    severity: str = "warning"
    settings: dict = field(default_factory=dict)
    enabled: bool = True


class RuleSet:
    """Rules by set name, with overrides of enabled, severity and settings."""

    def __init__(self) -> None:
        self.sets: dict[str, dict[str, Rule]] = {"default": {}}

    def register(self, rule: Rule, *names: str) -> None:
        for name in names or ("default",):
            self.sets.setdefault(name, {})[rule.rule_id] = rule

    def override(self, rule_id: str, **changes) -> None:
        for rules in self.sets.values():
            if rule_id in rules:
                settings = rules[rule_id].settings | changes.pop("settings", {})
                rules[rule_id] = replace(rules[rule_id], settings=settings, **changes)

    def of(self, name: str = "default") -> list[Rule]:
        """Enabled rules of a set and of the default set, by id."""
        both = self.sets["default"] | self.sets.get(name, {})
        return [both[k] for k in sorted(both) if both[k].enabled]

    def violations(self, df: DataFrame, keys: list[str], name: str = "default", only: list[str] | None = None) -> DataFrame:
        """One row for each rule (or each of ``only``) that a row of ``df`` breaks: one pass, whatever the number of rules."""
        found = [F.when(r.broken(r.settings), F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.severity).alias("severity"), F.lit(r.message.format(**r.settings)).alias("message"))) for r in self.of(name) if only is None or r.rule_id in only]
        # an outer explode, as the filter that a plain one puts below itself would judge all rules a second time
        return df.select(*keys, F.explode_outer(F.array(*found)).alias("v")).where("v IS NOT NULL").select(*keys, "v.*")


def summary(violations: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by severity; valid without errors."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    return violations.groupBy(*keys).agg(*counts).withColumn("valid", F.col("error") == 0)


def contrast(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Contrast of two colours with channels from 0 to 255, from 1 to 21."""

    def luminance(rgb: tuple[Column, Column, Column]) -> Column:
        linear = [F.when(c / 255 <= 0.03928, c / 255 / 12.92).otherwise(F.pow((c / 255 + 0.055) / 1.055, F.lit(2.4))) for c in rgb]
        return 0.2126 * linear[0] + 0.7152 * linear[1] + 0.0722 * linear[2]

    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def informal(low: Column) -> Column:
    """Whether a text in lower case contains an informal wording: plain searches, which end at the first one that is found."""
    return X.any_of([F.contains(low, F.lit(w)) for w in INFORMAL])


def uncited(text: Column) -> Column:
    """Whether a text makes a claim and has no citation."""
    low, plain = F.lower(text), [c for c in CLAIMS if c.replace(" ", "").isalpha()]
    # each of the patterns needs one of these, so most texts are not matched at all
    hint = X.any_of([F.contains(low, F.lit(c)) for c in ("%", "studies", "research", "data", "evidence", "findings", "results", "analysis")])
    claim = X.any_of([F.contains(low, F.lit(c)) for c in plain]) | (hint & low.rlike("|".join(c for c in CLAIMS if c not in plain)))
    return claim & ~text.rlike("|".join(CITED))


def hits(low: Column, listed: list[str]) -> Column:
    """How many white-space separated words of a text are in the list."""
    words = F.concat(F.lit(" "), F.regexp_replace(low, r"\s+", "  "), F.lit(" "))
    return F.when(X.any_of([F.contains(low, F.lit(w)) for w in listed]), F.regexp_count(words, F.lit(f" (?:{'|'.join(listed)}) "))).otherwise(F.when(low.isNotNull(), 0))


def slide_rules() -> RuleSet:
    """The standard rules for slides with the columns text, n_words, n_sentences, n_syllables, grade and role."""
    out = RuleSet()
    low = lambda: F.lower("text")
    out.register(Rule("text.density", lambda s: F.col("n_words") > s["most"], "more than {most} words", settings={"most": 100}))
    out.register(Rule("text.title_length", lambda s: F.char_length(F.get(F.split("text", r"\n"), F.lit(0))) > s["most"], "first line longer than {most}", settings={"most": 60}))
    out.register(Rule("text.readability", lambda s: F.col("grade") > s["most"], "grade above {most}", "info", {"most": 16}))
    out.register(Rule("text.bullets", lambda s: F.size(F.split("text", r"\n")) > s["most"], "more than {most} lines", settings={"most": 5}))
    out.register(Rule("time.slide", lambda s: F.col("n_words") / 130 * 60 > s["most"], "longer than {most} seconds", settings={"most": 120}), "conference")
    out.register(Rule("tone.informal", lambda s: informal(low()), "informal wording"))
    out.register(Rule("cite.claim", lambda s: uncited(F.col("text")), "claim without citation"))
    out.register(Rule("tone.transitions", lambda s: (F.col("n_words") > s["least"]) & (hits(low(), TRANSITIONS) == 0), "no transitions in more than {least} words", "info", {"least": 50}))
    out.register(Rule("tone.vague", lambda s: hits(low(), VAGUE) > 0, "vague intensifiers", "info"))
    return out

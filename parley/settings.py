"""Run settings, column names and lexicons."""

from __future__ import annotations

from dataclasses import dataclass

# Column names, lexicons and labels that the results depend on.
MULTILABEL_TEXT = "comment_text"
MULTILABEL_LABELS = ("toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate")
SCORED_TEXT_CANDIDATES = ("comment_text", "text")
SCORED_LABEL_CANDIDATES = ("target", "toxicity")
IDENTITY_SCORE_COLUMNS = (
    "asian", "atheist", "bisexual", "black", "buddhist", "christian", "female",
    "heterosexual", "hindu", "homosexual_gay_or_lesbian",
    "intellectual_or_learning_disability", "jewish", "latino", "male", "muslim",
    "other_disability", "other_gender", "other_race_or_ethnicity", "other_religion",
    "other_sexual_orientation", "physical_disability",
    "psychiatric_or_mental_illness", "transgender", "white",
)
IDENTITY_TERMS = (
    "asian", "atheist", "bisexual", "black", "buddhist", "christian", "disabled",
    "disability", "female", "gay", "heterosexual", "hindu", "homosexual", "jewish",
    "latino", "lesbian", "male", "muslim", "psychiatric", "queer", "trans",
    "transgender", "white", "woman", "women", "man", "men",
)
EXPLICIT_TERMS = (
    "asshole", "bastard", "bitch", "bullshit", "cunt", "dick", "dumbass", "fuck",
    "idiot", "moron", "shit", "slut", "whore",
)
UPLOAD_TEXT_CANDIDATES = (
    "comment_text", "comment", "comments", "text", "content", "message", "body",
    "raw_text", "clean_text",
)
# Cell texts that the corpus CSV readers treat as missing (pandas' documented defaults).
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


@dataclass(frozen=True)
class CueTerm:
    keyword: str
    category: str
    severity: str


# Reviewer cue terms, in priority order.
CUE_TERMS = (
    CueTerm("stupid", "Direct insult", "High"),
    CueTerm("idiot", "Direct insult", "High"),
    CueTerm("moron", "Direct insult", "High"),
    CueTerm("dumb", "Direct insult", "Medium"),
    CueTerm("garbage", "Dismissive language", "Medium"),
    CueTerm("trash", "Dismissive language", "Medium"),
    CueTerm("useless", "Dismissive language", "High"),
    CueTerm("nonsense", "Dismissive language", "Low"),
    CueTerm("pathetic", "Direct insult", "High"),
    CueTerm("shut up", "Hostile language", "High"),
    CueTerm("loser", "Direct insult", "High"),
    CueTerm("worthless", "Direct insult", "High"),
    CueTerm("hate you", "Hostile language", "High"),
    CueTerm("go die", "Threat-like language", "High"),
    CueTerm("kill you", "Threat-like language", "High"),
    CueTerm("hurt you", "Threat-like language", "High"),
)


@dataclass(frozen=True)
class PrepSettings:
    """Everything that changes what corpus preparation computes, by the step that it changes.

    Fixed values that published results depend on: the two thresholds, the seed, the three
    sizes, the drift limit and the least split.
    """

    # Loading: names in tables and warnings; malformed CSV rows end the load or are left out.
    multilabel_source: str = "multilabel"
    scored_source: str = "scored"
    on_malformed: str = "fail"

    # Labels.
    score_threshold: float = 0.5
    strict_missing_labels: bool = False
    remove_missing_labels: bool = True

    # Texts and duplicates.
    url_token: str = "<URL>"
    email_token: str = "<EMAIL>"
    replace_urls: bool = True
    replace_emails: bool = True
    remove_missing_text: bool = True
    fold_duplicates: bool = True
    remove_duplicates: bool = True

    # Slices and lengths.
    identity_terms: tuple[str, ...] = IDENTITY_TERMS
    explicit_terms: tuple[str, ...] = EXPLICIT_TERMS
    identity_threshold: float = 0.5
    require_token_lengths: bool = False

    # Splits; the second draws use the seeds that follow.
    seed: int = 42
    test_size: float = 0.15
    val_size: float = 0.15
    external_size: float = 0.20

    # Gates and warnings.
    fail_on_leakage: bool = True
    drift_limit: float = 0.03
    small_split_rows: int = 100

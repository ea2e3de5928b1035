"""Parameters of the operators: thresholds that are part of the semantics, and default word lists (replace them with your own)."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Sizes, ages and counts that decide results.
CHUNK_CHARS, CHUNK_OVERLAP, CHUNK_LOOKBACK, SEGMENT_WINDOW = 4000, 200, 400, 600.0
NEAR_RATIO, SHORT_SEGMENT, SENTENCE_KEY = 0.9, 8, 8
MIN_CONTENT, CLASSIFY_PREFIX, INTERVIEW_PREFIX = 100, 800, 2500
AD_DOC_CHARS, AD_HITS, AD_BLOCK_CHARS = 1500, 2, 140
BAND_DROP, BAND_LIGHT, SUBSTANTIVE = 20, 80, 15
STATE_KEEP, BACKFILL_BATCH, REFETCH_MAX = 1000, 15, 3
WINDOW_DAYS, DAILY_DAYS, FIRST_DAYS, CAP_DAYS, SAFETY_CAP = 2, 1, 7, 30, 50
GATE_SCORE = 85
#: Sentence marks, in the order in which a cut is looked for.
SEPARATORS = ["。", ".", "！", "!", "？", "?", "；", ";"]
STATES = ["pending", "raw_ready", "summarized", "landed", "verified"]


@dataclass(frozen=True)
class Lexicons:
    """Word lists; matching is by substring, case-sensitive unless an operator says otherwise."""

    ad_titles: tuple[str, ...] = ("Licensed under", "Copyright", "Sponsored", "Advertisement")
    ad_phrases: tuple[str, ...] = ("Licensed under", "Apache License", "CC BY", "token = ", "sponsored by", "use code", "limited offer", "sign up now")
    ad_strong: tuple[str, ...] = ("Licensed under", "sponsored by", "use code")
    wall_markers: tuple[str, ...] = ("captcha", "verify you are human", "subscribe to read", "access denied")
    post_noise: tuple[str, ...] = ("shared a post", "new video", "live now")
    tutorial: tuple[str, ...] = ("how to", "step by step", "tutorial")
    interview: tuple[str, ...] = ("interview", "q&a", "in conversation", "conversation with")
    key_points: tuple[str, ...] = ("talk", "keynote", "lecture", "ted")
    roundup: tuple[str, ...] = ("roundup", "weekly", "digest", "news")
    reading: tuple[str, ...] = ("book", "chapter", "reading")
    opinion: tuple[str, ...] = ("opinion", "debate", "why i")
    case: tuple[str, ...] = ("case study", "post-mortem", "example")
    structured: tuple[str, ...] = ("guide", "analysis", "overview")
    host_probes: tuple[str, ...] = ("tell us", "what do you", "could you", "how did you")
    audience_probes: tuple[str, ...] = ("asks", "from the audience", "a question from")
    tag_terms: tuple[str, ...] = ("python", "data", "video", "science", "history", "music", "business")
    system_tags: tuple[str, ...] = ("repost", "fresh", "recent", "archive", "structured", "interview")
    fillers: tuple[str, ...] = ("you know", "well", "um", "uh", "so")
    retryable: tuple[str, ...] = ("timeout", "timed out", "rate limit", "too many requests", "overloaded", "503", "502", "429", "connection reset", "temporarily")
    type_labels: dict[str, str] = field(default_factory=lambda: {"structured": "Notes", "interview": "Interview", "key_points": "Key points", "roundup": "Roundup", "reading": "Reading", "opinion": "Opinion", "case": "Case"})


DEFAULT = Lexicons()

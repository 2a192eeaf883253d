"""Options of a run, as plain Python values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from leadloom import constants as K
from leadloom.functions.contacts import PhoneRules


@dataclass(frozen=True)
class MappingOptions:
    required_any: Sequence[str] = K.REQUIRED_ANY
    aliases: Mapping[str, Sequence[str]] = field(default_factory=lambda: dict(K.HEADER_ALIASES))
    defaults: Mapping[str, str] = field(default_factory=lambda: dict(K.FIELD_DEFAULTS))
    strict_contacts: bool = True


@dataclass(frozen=True)
class NormalizeOptions:
    # "chars" strips any leading run of the characters w and '.', "prefix" strips only "www."
    www: str = "chars"


@dataclass(frozen=True)
class PageOptions:
    enabled: bool = True
    discover: bool = True
    chat_keywords: Sequence[str] = K.CHAT_KEYWORDS
    # "contains" blocks a host that contains a blocked name anywhere, "suffix" only the site itself
    blocked_host_match: str = "contains"
    # None takes every given link and search result; a number only the first so many
    max_contact_pages: int | None = None
    max_search_links: int | None = None


@dataclass(frozen=True)
class PlaceOptions:
    enabled: bool = True
    min_name_match: float = K.MIN_NAME_MATCH
    similarity: str = "levenshtein"  # inside the JVM; or "gestalt", the Ratcliff/Obershelp ratio, in Python workers
    max_candidates: int | None = None  # None takes every answer of the directory, a number those of the first ranks


@dataclass(frozen=True)
class ResolveOptions:
    # True drops the lead's own e-mail/phone re-proposed under the place stage's name
    strict_provenance: bool = False


@dataclass(frozen=True)
class ScoreOptions:
    enabled: bool = True
    base_score: int = K.BASE_SCORE
    weights: Mapping[str, float] = field(default_factory=dict)

    def weight(self, name: str) -> float:
        return float(self.weights.get(name, K.SCORE_WEIGHTS[name]))


@dataclass(frozen=True)
class RunOptions:
    mapping: MappingOptions = MappingOptions()
    normalize: NormalizeOptions = NormalizeOptions()
    pages: PageOptions = PageOptions()
    places: PlaceOptions = PlaceOptions()
    resolve: ResolveOptions = ResolveOptions()
    score: ScoreOptions = ScoreOptions()
    # a region, or functions.contacts.PhoneRules with numbering plans of one's own
    phone_region: str | PhoneRules = K.DEFAULT_PHONE_REGION
    run_ts: datetime | None = None
    # write each stage to the shared checkpoint folder, so that a lost executor replays one stage only
    stage_tables: bool = False

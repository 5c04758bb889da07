"""Tag lists and line patterns of the canonical form."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Fixed values. Paired tags go with all they enclose, in this order (outer before inner).
PAIRED_TAGS = ["callout", "toggle", "synced_block", "column_list", "column", "button", "ai_block", "equation"]
# Fixed values. Tags that stand alone; the tag itself goes.
SINGLE_TAGS = ["embed", "bookmark", "link_preview", "equation", "file", "audio", "video", "pdf", "data-source", "empty-block"]
# Fixed values. HTML elements that authors may write in markdown; they stay.
HTML_TAGS = frozenset(
    """a abbr address article aside b bdi bdo blockquote br caption cite code col colgroup data dd del details dfn div dl dt
    em figcaption figure footer h1 h2 h3 h4 h5 h6 header hr i img ins kbd li main mark nav ol p pre q rb rp rt rtc ruby s
    samp section small span strong sub summary sup table tbody td tfoot th thead time tr u ul var wbr""".split()
)
# Fixed values. Characters whose backslash is dropped in prose (as a character class body).
ESCAPED = r"$~#|*_`{}()>+\-.!\[\]"
# Fixed value. Bound on slugs, in characters.
SLUG_LENGTH = 80

ID = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


@dataclass(frozen=True)
class Dialect:
    """What a deployment chooses: the marker in link comments, the hosts of page urls and the base of absolute ones."""

    marker: str = "tree:child"
    hosts: str = r"wiki\.example"
    base_url: str = "https://wiki.example/"

    @property
    def managed(self) -> str:
        """A whole trimmed line: a link to a child page with its id. Escaped brackets may stand in the title."""
        return r"(?i)^\[(?:\\.|[^\]\\])*\]\([^)]+\)\s*<!--\s*" + re.escape(self.marker) + r'\s+page_id="(' + ID + r')"(\s+external)?\s*-->\s*$'

    @property
    def placeholder(self) -> str:
        """A whole trimmed line: a link to a child page that has no id yet."""
        return r"(?i)^\[[^\]]*\]\(([^)]+)\)\s*<!--\s*" + re.escape(self.marker) + r"\s*-->\s*$"

    @property
    def page_url(self) -> str:
        """A url of a page; group 1 is the path that ends in its id."""
        return "(?:" + self.hosts + r")/(?:p/)?([a-zA-Z0-9_\-]*[0-9a-fA-F])"


DEFAULT = Dialect()

IMAGE_LINE = r"^!\[[^\]]*\]\([^)]+\)(\s*\{[^}]*\})?$"
PAGE_LINE = r"(?i)^<page\b.*</page>$"
PAGE_SPAN = r"(?is)<page\b[^>]*>.*?</page>"
PAGE_TAG = r"(?i)<page\b[^>]*?/?>"
TABLE_SPAN = r"(?is)<table\b[^>]*>.*?</table>"
FENCE = r"(?md)^[ \t]{0,3}```[a-zA-Z0-9_+\-]*[ \t]*\n(?s:.*?)^[ \t]{0,3}```[ \t]*$"
SEPARATOR_LINE = r"^[ \t]*\|([ \t]*:?-+:?[ \t]*\|)+[ \t]*\z"
#: Python's white space as a Java class (with the U flag).
BLANK = r"[\s\x1c-\x1f]"


def paired(tag: str) -> str:
    return rf"(?is)<{tag}\b[^>]*>.*?</{tag}>"


def single(tag: str) -> str:
    return rf"(?i)<{tag}\b[^>]*?/?>"

"""Text clean-up, links, subjects and paths as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

# Characters a link may hold (fixed values): host characters, and all of them.
HOST = r"a-zA-Z0-9.=_\-%&"
LINK = HOST + r"/?#"

# One pass over every link: a link with a host keeps scheme and host, a link
# without a host stays whole.
_SHORTEN_LINK = (
    rf"(https?://[{HOST}]+)[{LINK}]*"
    rf"|(https?://[/?#][{LINK}]*)"
    rf"|(www\.[{HOST}]+)[{LINK}]*"
    rf"|(www\.)[/?#][{LINK}]*"
)
# What quoted-printable leaves behind in charset names, and the fallback (fixed values).
CHARSET_NOISE = "3d|="
DEFAULT_CHARSET = "utf-8"

_ANY_LINK = rf"(https?://[{LINK}]+|www\.[{LINK}]+)"
_LINK_HOST = rf"^(https?://[{HOST}]+|www\.[{HOST}]*)"
# Characters cleaning turns into blanks (fixed values).
_ODD_CHARS = r"[\x00-\x1F\x7F-\x9F\x{200C}\x{A0}]"
_BLANKS = r"(?U)\s+"
_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: ColumnLike) -> Column:
    """Remove every kind of white space at both ends (``trim`` drops blanks only)."""
    return F.regexp_replace(_col(c), _EDGES, "")


def as_text(c: ColumnLike) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def clean_basic(text: ColumnLike) -> Column:
    """Control characters to blanks, runs of white space to one blank, trimmed."""
    plain = F.regexp_replace(F.coalesce(_col(text), F.lit("")), _ODD_CHARS, " ")
    return F.trim(F.regexp_replace(plain, _BLANKS, " "))


def clean_email_text(text: ColumnLike) -> Column:
    """``clean_basic`` after cutting every link back to its host."""
    return clean_basic(F.regexp_replace(_col(text), _SHORTEN_LINK, "$1$2$3$4"))


def url_domain_array(text: ColumnLike) -> Column:
    links = F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(_ANY_LINK), 1)
    hosts = F.transform(links, lambda x: F.regexp_extract(x, _LINK_HOST, 1))
    return F.array_sort(F.array_distinct(F.filter(hosts, lambda h: h != "")))


def url_domains(text: ColumnLike) -> Column:
    """Distinct link hosts in sorted order, joined by blanks."""
    return F.array_join(url_domain_array(text), " ")


def subject_body(subject: ColumnLike, body: ColumnLike) -> Column:
    return strip(F.concat(as_text(subject), F.lit(" "), as_text(body)))


def base_lang(lang: ColumnLike) -> Column:
    """``zh-cn`` -> ``zh``."""
    return F.split_part(_col(lang), F.lit("-"), F.lit(1))


def html_key(msg_id: ColumnLike, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), _col(msg_id), F.lit(".html"))


def hyperlink(file_id: ColumnLike) -> Column:
    """Spreadsheet formula that opens the stored HTML file."""
    fid = _col(file_id)
    # Link and formula layout are fixed values read by the labelling sheet.
    url = F.concat(F.lit("https://drive.google.com/file/d/"), fid, F.lit("/view"))
    formula = F.concat(F.lit('=HYPERLINK("'), url, F.lit('", "HTML File")'))
    return F.when(F.coalesce(fid, F.lit("")) != "", formula).otherwise(F.lit("Not Found"))


def file_name(path: ColumnLike) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def user_from_path(path: ColumnLike) -> Column:
    """User id from ``.../users/<uid>/<file>``; a ``name=`` prefix is allowed."""
    return F.regexp_extract(_col(path), r"users/(?:[^/=]+=)?([^/]+)/[^/]+$", 1)


def normalise_charset(name: ColumnLike) -> Column:
    """Repair charset names damaged by quoted-printable; the caller checks they exist."""
    repaired = F.regexp_replace(F.lower(strip(_col(name))), CHARSET_NOISE, "")
    return F.coalesce(F.nullif(repaired, F.lit("")), F.lit(DEFAULT_CHARSET))


def parse_time(c: ColumnLike) -> Column:
    """Text to timestamp; null where it is no date."""
    return F.try_to_timestamp(_col(c).cast("string"))

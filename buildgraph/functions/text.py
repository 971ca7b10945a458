"""Scalar column expressions.  All of them are native Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STORE_PREFIX = "/nix/store/"
HASH_LENGTH = 32
REGISTRY = "https://registry.npmjs.org"
CRATES = "https://static.crates.io/crates"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def label(parts: str | Column, sub: str | Column | None = None) -> Column:
    """``a/b/c`` from path parts, or ``a/b/c:sub`` when a sub-target is named."""
    base = F.concat_ws("/", _col(parts))
    if sub is None:
        return base
    sub = _col(sub)
    return F.when(sub.isNull(), base).otherwise(F.concat(base, F.lit(":"), sub))


def attr_path(parts: str | Column, sub: str | Column) -> Column:
    """Path parts followed by the sub-target, when there is one."""
    parts, sub = _col(parts), _col(sub)
    return F.when(sub.isNull(), parts).otherwise(F.concat(parts, F.array(sub)))


def store_name(path: str | Column) -> Column:
    """Store path without its folder and hash: ``/nix/store/<32 chars>-name`` gives ``name``."""
    start = len(STORE_PREFIX) + HASH_LENGTH + 2
    return F.substring(_col(path), start, 1 << 30)


def basename(path: str | Column) -> Column:
    """Text after the last slash."""
    return F.substring_index(_col(path), "/", -1)


def step_key(drv: str | Column) -> Column:
    """Step key of a derivation: ``drv-`` and the first 32 characters of its base name."""
    return F.concat(F.lit("drv-"), F.substring(basename(drv), 1, HASH_LENGTH))


def split_system(system: str | Column) -> tuple[Column, Column]:
    """(arch, os) around the first dash; without a dash the arch is ``unknown``."""
    s = _col(system)
    at = F.instr(s, "-")
    arch = F.when(at > 0, F.substring(s, F.lit(1), at - 1)).otherwise(F.lit("unknown"))
    os = F.when(at > 0, F.substring(s, at + 1, F.length(s))).otherwise(s)
    return arch, os


def duration_text(ms: str | Column) -> Column:
    """Milliseconds shown as seconds with one decimal, for display only."""
    ms = _col(ms)
    return F.when(ms.isNotNull(), F.format_string("%.1fs", ms / F.lit(1000.0)))


def decode_id(encoded: str | Column) -> Column:
    """Base64 text decoded to a digit string; null when it is anything else."""
    raw = F.try_to_binary(_col(encoded), F.lit("base64"))
    text = F.try_validate_utf8(raw.cast("string"))
    return F.when(text.rlike("^[0-9]+$"), text)


def unscoped(name: str | Column) -> Column:
    """Package name without its ``@scope/``."""
    return F.substring_index(_col(name), "/", -1)


def tarball_name(name: str | Column, version: str | Column) -> Column:
    """File name of a package tarball; the scope is left out."""
    return F.concat(unscoped(name), F.lit("-"), _col(version), F.lit(".tgz"))


def tarball_url(name: str | Column, version: str | Column) -> Column:
    """Registry address of a package tarball."""
    return F.concat(F.lit(REGISTRY + "/"), _col(name), F.lit("/-/"), tarball_name(name, version))


def encode_name(name: str | Column) -> Column:
    """Percent-encoding with no safe characters but the unreserved ones."""
    c = F.url_encode(_col(name))
    for found, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        c = F.replace(c, F.lit(found), F.lit(wanted))
    return c


def registry_doc_url(name: str | Column) -> Column:
    """Registry address of a package document."""
    return F.concat(F.lit(REGISTRY + "/"), encode_name(name))


def crate_url(name: str | Column, version: str | Column) -> Column:
    """Download address of a crate archive."""
    n, v = _col(name), _col(version)
    return F.concat(F.lit(CRATES + "/"), n, F.lit("/"), n, F.lit("-"), v, F.lit(".crate"))


def registry_crate_url(
    template: str | Column, name: str | Column, version: str | Column, sha256: str | Column
) -> Column:
    """Crate address from a registry's download template.

    Placeholders are replaced when the template has any; otherwise
    ``/<name>/<version>/download`` is appended.
    """
    t, n, v, s = (_col(c) for c in (template, name, version, sha256))
    size = F.length(n)
    prefix = (
        F.when(size == 1, F.lit("1"))
        .when(size == 2, F.lit("2"))
        .otherwise(F.concat(F.substring(n, 1, 2), F.lit("/"), F.substring(n, F.lit(3), size)))
    )
    filled = t
    for mark, value in (
        ("{crate}", n),
        ("{version}", v),
        ("{prefix}", prefix),
        ("{lowerprefix}", F.lower(prefix)),
        ("{sha256-checksum}", s),
    ):
        filled = F.replace(filled, F.lit(mark), value)
    has_mark = t.rlike(r"\{(crate|version|prefix|lowerprefix|sha256-checksum)\}")
    plain = F.concat(t, F.lit("/"), n, F.lit("/"), v, F.lit("/download"))
    return F.when(has_mark, filled).otherwise(plain)


def strip_trailing_slashes(path: str | Column) -> Column:
    """Path without any slashes at its end."""
    return F.regexp_replace(_col(path), "/+$", "")


def civil_date(ts: str | Column, zone: str = "America/Los_Angeles") -> Column:
    """Calendar date of a UTC timestamp in ``zone``."""
    return F.to_date(F.from_utc_timestamp(_col(ts), zone))


def valid_json(text: str | Column) -> Column:
    """Whether a text is one JSON value and nothing else.

    The JSON functions ignore what follows the first value.  Wrapped once as an
    array element and once as an object member, a text parses both ways only if
    nothing follows.  The root path is read as a stream, so a text of any size
    is judged alike.
    """
    t = _col(text)
    element = F.get_json_object(F.concat(F.lit("["), t, F.lit("]")), "$")
    member = F.get_json_object(F.concat(F.lit('{"v":'), t, F.lit("}")), "$")
    return element.isNotNull() & member.isNotNull()


def last_lines(text: str | Column, n: int) -> Column:
    """Last ``n`` lines of a text; one final newline does not count as a line."""
    t = _col(text)
    lines = F.split(F.regexp_replace(t, "\r?\n\\z", ""), "\r?\n")
    kept = F.when(F.size(lines) > n, F.slice(lines, -n, n)).otherwise(lines)
    return F.array_join(kept, "\n")

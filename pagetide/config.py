"""Job settings. Every value is a literal that ends up inside a Catalyst expression."""

from __future__ import annotations

from dataclasses import dataclass, field

REFRESH_MODES = ("auto", "force", "none")
CONTENT_MODES = ("auto", "body")
HEADING_STYLES = ("atx", "setext")

# File types a link planner does not visit (images, audio, video, office, archives, others).
BINARY_EXTENSIONS = (
    "7z", "7zip", "bz2", "rar", "tar", "tar.gz", "xz", "zip",
    "mng", "pct", "bmp", "gif", "jpg", "jpeg", "png", "pst", "psp", "tif", "tiff", "ai", "drw",
    "dxf", "eps", "ps", "svg", "cdr", "ico", "webp",
    "mp3", "wma", "ogg", "wav", "ra", "aac", "mid", "au", "aiff",
    "3gp", "asf", "asx", "avi", "mov", "mp4", "mpg", "qt", "rm", "swf", "wmv", "m4a", "m4v", "flv", "webm",
    "xls", "xlsm", "xlsx", "xltm", "xltx", "potm", "potx", "ppt", "pptm", "pptx", "pps",
    "doc", "docb", "docm", "docx", "dotm", "dotx", "odt", "ods", "odg", "odp",
    "css", "pdf", "exe", "bin", "rss", "dmg", "iso", "apk", "jar", "sh", "rb", "js", "hta", "bat", "cpl",
    "msi", "msp", "py",
)


@dataclass(frozen=True)
class Scope:
    """Which pages and links belong to the corpus."""

    seeds: tuple[str, ...] = ()
    domains: tuple[str, ...] = ()
    include_subdomains: bool = True
    prefixes: tuple[str, ...] = ()
    respect_robots: bool = True
    deny_extensions: tuple[str, ...] = BINARY_EXTENSIONS

    @staticmethod
    def of(seeds=(), domains=(), prefixes=(), **rest) -> Scope:
        """Build a scope from loose arguments; prefixes may be one comma-separated string.

        Without domains, the authority of every seed becomes one.
        """
        as_tuple = lambda v: (v,) if isinstance(v, str) else tuple(v or ())
        if isinstance(prefixes, str):
            prefixes = prefixes.split(",")
        seeds, domains = as_tuple(seeds), as_tuple(domains)
        if not domains:
            domains = tuple(dict.fromkeys(s.split("://", 1)[-1].split("/")[0].split("?")[0] for s in seeds))
        prefixes = tuple(p.strip() for p in prefixes or () if p and p.strip())
        return Scope(seeds=seeds, domains=domains, prefixes=prefixes, **rest)


@dataclass(frozen=True)
class Refresh:
    """When a known page is looked at again, and whether a page that is not due is still emitted."""

    mode: str = "auto"
    days: int = 7
    output_cached: bool = True

    def __post_init__(self):
        if self.mode not in REFRESH_MODES:
            raise ValueError(f"refresh mode must be one of {REFRESH_MODES}, not {self.mode!r}")
        if self.days < 0:
            raise ValueError("refresh days must not be negative")


@dataclass(frozen=True)
class Extract:
    """How the main content of a page is chosen."""

    mode: str = "auto"

    def __post_init__(self):
        if self.mode not in CONTENT_MODES:
            raise ValueError(f"content mode must be one of {CONTENT_MODES}, not {self.mode!r}")


@dataclass(frozen=True)
class Markdown:
    """Options of the HTML to Markdown job."""

    enabled: bool = False
    heading_style: str = "atx"
    preserve_images: bool = True
    preserve_tables: bool = True
    ignore_links: bool = False
    code_highlighting: bool = True
    rewrite_emphasis: bool = True

    def __post_init__(self):
        if self.heading_style not in HEADING_STYLES:
            raise ValueError(f"heading style must be one of {HEADING_STYLES}, not {self.heading_style!r}")


@dataclass(frozen=True)
class Pack:
    """Size-bounded shards."""

    max_bytes: int = 50 * 1024 * 1024
    prefix: str = "part"
    rows_per_block: int = 500_000
    fan_in: int = 16

    def __post_init__(self):
        if self.max_bytes < 1 or self.rows_per_block < 1 or self.fan_in < 2:
            raise ValueError("max_bytes and rows_per_block must be positive, fan_in at least 2")


@dataclass(frozen=True)
class Chunk:
    """Fixed-size byte chunks."""

    bytes: int = 1024 * 1024
    prefix: str = "part_"

    def __post_init__(self):
        if self.bytes < 1:
            raise ValueError("chunk size must be positive")


@dataclass(frozen=True)
class Combine:
    """Layout of a combined Markdown document."""

    title_default: str = "No Title"
    url_default: str = "No URL"
    separator: str = "\n\n---\n\n"
    heading: str = field(default="Combined Markdown Content")

"""Regular-expression steps before and after the HTML to Markdown conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetide.config import Markdown
from pagetide.functions.text import strip

# Patterns that must match the same text as the converter this engine agrees with.
CODE_BLOCK = r"""(?s)(?U)<pre><code\s+class=["'](language-|lang-)(\w+)["']>(.*?)</code></pre>"""
FENCE = r"(?s)(?U)```\s*(\w+)?\n(.*?)\n```"
BRACKETED_LINK = r"\[([^\]]+)\]\(<([^>]+)>\)"
SINGLE_UNDERSCORE = r"_([^_\n]+?)_"
DOUBLE_UNDERSCORE = r"__([^_\n]+?)__"


def mark_code_languages(html: Column, options: Markdown) -> Column:
    """Move the language class of a code block to its pre tag."""
    if not options.code_highlighting:
        return html
    return F.regexp_replace(html, CODE_BLOCK, r'<pre lang="$2"><code>$3</code></pre>')


def tidy_markdown(markdown: Column, options: Markdown) -> Column:
    """Blank lines, fences, link targets and emphasis marks, in this order."""
    out = F.regexp_replace(markdown, r"\n{3,}", "\n\n")
    if options.code_highlighting:
        out = F.regexp_replace(out, FENCE, "```$1\n$2\n```")
    if not options.ignore_links:
        out = F.regexp_replace(out, BRACKETED_LINK, "[$1]($2)")
    if options.rewrite_emphasis:
        out = F.regexp_replace(out, SINGLE_UNDERSCORE, "*$1*")
        out = F.regexp_replace(out, DOUBLE_UNDERSCORE, "**$1**")
    return strip(out)

"""Identity keys of a contact row: mailbox, personal profile, id at its provider."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.values import present

# Local parts that belong to a department or function, not to a person.
FUNCTION_MAILBOXES = (
    "abuse", "accounting", "accounts", "admin", "administration", "backoffice", "billing", "bookings", "careers", "contact", "customerservice",
    "desk", "einkauf", "enquiries", "events", "facturacion", "feedback", "finance", "frontdesk", "hello", "help", "helpdesk", "hi", "hostmaster", "hr",
    "info", "information", "inquiries", "invoice", "invoices", "it", "jobs", "kontakt", "legal", "mail", "marketing", "media", "news", "newsletter", "no-reply",
    "noreply", "office", "orders", "partners", "postmaster", "press", "privacy", "procurement", "purchasing", "reception", "recruiting", "sales", "security",
    "service", "shop", "support", "team", "ventas", "webmaster", "welcome",
)

ADDRESS = "[\\p{L}\\p{N}._%+'&=~-]+@[\\p{L}\\p{N}-]+(?:\\.[\\p{L}\\p{N}-]+)+"
PLAIN = "[\\p{L}\\p{N}][\\p{L}\\p{N}._%+-]*@[\\p{L}\\p{N}-]+(?:\\.[\\p{L}\\p{N}-]+)+"
PROFILE = "(?i)linkedin\\.[a-z.]+/(?:in|pub)/([^/?#\\s]+)"


def mailbox(c: Column | str) -> Column:
    """The bare lower-case address of a cell that states exactly one, in whatever notation; else null."""
    t = F.lower(present(c))
    inner = F.when(t.contains("<"), F.regexp_extract(t, "<\\s*([^<>]*?)\\s*>", 1)).otherwise("")
    bare = F.regexp_replace(F.regexp_replace(F.when(inner != "", inner).otherwise(t), "^mailto:\\s*", ""), "^[\"'(\\[]+|[\"')\\].,;:]+$", "")
    # Nearly all cells are a plain address or hold none: only the others are taken apart.
    return F.when(t.rlike(f"^{PLAIN}$"), t).when(t.contains("@"), F.when(bare.rlike(f"^{ADDRESS}$"), bare))


def is_function(address: Column) -> Column:
    return F.substring_index(F.substring_index(address, "@", 1), "+", 1).isin(*FUNCTION_MAILBOXES)


def personal(address: Column) -> Column:
    """An address (``mailbox``) that is a person's, else null."""
    return F.when(~is_function(address), address)


def profile(c: Column | str) -> Column:
    """The slug of a personal profile page, lower case; null for company pages and broken links."""
    c = F.col(c) if isinstance(c, str) else c
    slug = F.lower(F.regexp_extract(c, PROFILE, 1))
    return F.when(c.contains("/") & (slug != ""), slug)


def external(c: Column | str, provider: Column | str) -> Column:
    """The id at its provider; null for missing ids and ``0``."""
    t = present(c)
    return F.when(F.translate(t, "0", "") != "", F.concat_ws("\u0001", F.coalesce(F.lower(present(provider)), F.lit("")), t))

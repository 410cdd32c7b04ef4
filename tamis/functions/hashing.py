"""SHA-256 text digests: chains, commitments, seeds and tickets."""

from __future__ import annotations

import hashlib
import re
import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F

from tamis.functions.text import digits_only

#: Predecessor of the first link of a chain.
GENESIS = "0" * 64


def sha256_hex(x: Column) -> Column:
    return F.sha2(x, 256)


def chained(prefix: str, *parts: Column | str) -> Column:
    """Digest of prefix and parts joined by bars; nulls are empty."""
    return F.sha2(F.concat_ws("|", F.lit(prefix), *[F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts]), 256)


def ticket(seed_hex: str, application_id: Column | str) -> Column:
    return chained("ticket/1", F.lit(seed_hex), application_id)


def government_id_digest(x: Column | str, pepper: str) -> Column:
    digits = digits_only(x)
    return F.when(F.length(digits) >= 8, chained("gid/1", F.lit(pepper), digits)).otherwise("")


def text_digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def commitment(nonce: str) -> str:
    return text_digest(f"commit/1|{checked_nonce(nonce)}")


def checked_nonce(nonce: str) -> str:
    if not re.fullmatch("[0-9a-f]{64}", nonce or ""):
        raise ValueError("a nonce is 64 lower-case hexadecimal digits")
    return nonce


def reveal(roll_hash: str, entropy: str, nonce: str, committed: str) -> str:
    """The seed, after checking that the nonce is the committed one and that there is entropy."""
    if not (entropy or "").strip():
        raise ValueError("public entropy is blank")
    if commitment(nonce) != committed:
        raise ValueError("the nonce does not open the commitment")
    return text_digest(f"seed/1|{roll_hash}|{entropy}|{nonce}")


def new_nonce() -> str:
    return secrets.token_hex(32)

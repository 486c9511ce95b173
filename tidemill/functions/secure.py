"""Deterministic encryption (equality-preserving) and the Paillier cryptosystem.

Deterministic columns use Spark's own AES in ECB mode, so equal values stay equal and
joins work on ciphertexts.  Paillier ciphertexts exceed DECIMAL(38) and are decimal
strings; sums of plaintexts are products of ciphertexts modulo n squared, computed
by partial products per group and task.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def det_encrypt(value: Column, key: str) -> Column:
    return F.base64(F.aes_encrypt(value.cast("string"), F.lit(key), F.lit("ECB"), F.lit("PKCS")))


def det_decrypt(value: Column, key: str) -> Column:
    return F.aes_decrypt(F.unbase64(value), F.lit(key), F.lit("ECB"), F.lit("PKCS")).cast("string")


def _is_prime(n: int, rng: random.Random, rounds: int = 32) -> bool:
    if n < 4:
        return n in (2, 3)
    if n % 2 == 0:
        return False
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for _ in range(rounds):
        x = pow(rng.randrange(2, n - 1), d, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def _prime(bits: int, rng: random.Random) -> int:
    while True:
        p = rng.getrandbits(bits) | 1 | 3 << (bits - 2)
        if _is_prime(p, rng):
            return p


@dataclass(frozen=True)
class Paillier:
    """A key pair with g = n + 1; ``private`` parts are 0 in a public key."""

    n: int
    lam: int = 0
    mu: int = 0

    @classmethod
    def generate(cls, bits: int = 512, seed: int | None = None) -> Paillier:
        """A seed is for tests only; without it the system's randomness is used."""
        rng = random.SystemRandom() if seed is None else random.Random(seed)
        p = q = _prime(bits // 2, rng)
        while q == p:
            q = _prime(bits // 2, rng)
        n, lam = p * q, math.lcm(p - 1, q - 1)
        return cls(n, lam, pow(lam, -1, n))

    @property
    def public(self) -> Paillier:
        return Paillier(self.n)

    def encrypt(self, m: int, rng: random.Random | None = None) -> int:
        rng = rng or random.SystemRandom()
        n2 = self.n * self.n
        while math.gcd(r := rng.randrange(1, self.n), self.n) != 1:
            pass
        return (1 + m % self.n * self.n) * pow(r, self.n, n2) % n2

    def decrypt(self, c: int) -> int:
        n2 = self.n * self.n
        m = (pow(c, self.lam, n2) - 1) // self.n * self.mu % self.n
        return m - self.n if m > self.n // 2 else m


def paillier_encrypt(key: Paillier, seed: int | None = None):
    """A column function bigint -> decimal string."""
    public = key.public

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        rng = None if seed is None else random.Random(seed)
        return values.map(lambda v: None if pd.isna(v) else str(public.encrypt(int(v), rng)))

    return run


def paillier_decrypt(key: Paillier):
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda c: None if c is None else str(key.decrypt(int(c))))

    return run


def paillier_sum(df: DataFrame, by: str, cipher: str, key: Paillier, name: str = "product") -> DataFrame:
    """by (bigint), ciphertext of the group's sum.

    Each task multiplies what it has of a group before the shuffle, and streams the
    sorted partial products after it, so a hot group costs one row a task.
    """
    n2 = key.n * key.n

    def partial(batches):
        for b in batches:
            got: dict = {}
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if c is not None:
                    got[k] = got.get(k, 1) * int(c) % n2
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array([str(v) for v in got.values()], pa.string())], names=[by, name])

    def final(batches):
        at, value = None, None
        as_batch = lambda out: pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string())], names=[by, name])
        for b in batches:
            out = []
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if value is not None and k == at:
                    value = value * int(c) % n2
                    continue
                if value is not None:
                    out.append((at, str(value)))
                at, value = k, int(c)
            yield as_batch(out)
        if value is not None:
            yield as_batch([(at, str(value))])

    ddl = f"`{by}` bigint, `{name}` string"
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = df.select(F.col(by).cast("bigint").alias(by), cipher).mapInArrow(partial, ddl)
    return some.repartition(parts, by).sortWithinPartitions(by).mapInArrow(final, ddl)


def paillier_tumbling_sum(df: DataFrame, order: str, cipher: str, size: int, key: Paillier, name: str = "product") -> DataFrame:
    """block, ciphertext of the sum of each complete block of ``size`` arrivals."""
    from ..operators.sequencing import block_number, with_sequence

    numbered, n = with_sequence(df.select(order, cipher), order, "_seq")
    blocks = numbered.filter(F.col("_seq") <= n // size * size).select(block_number(F.col("_seq"), size).alias("block"), cipher)
    return paillier_sum(blocks, "block", cipher, key, name)

"""Ed25519 keys and signatures by the JVM's own provider, on the driver; digests of vectors."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def keypair(spark: SparkSession) -> tuple[str, str]:
    """(public, private) keys as base64 of their standard encodings."""
    jvm = spark._jvm
    pair = jvm.java.security.KeyPairGenerator.getInstance("Ed25519").generateKeyPair()
    enc, keys = jvm.java.util.Base64.getEncoder(), jvm.java.security.KeyFactory.getInstance("Ed25519")
    spec = lambda key, kind: keys.getKeySpec(key, jvm.java.lang.Class.forName(f"java.security.spec.{kind}")).getEncoded()
    return enc.encodeToString(spec(pair.getPublic(), "X509EncodedKeySpec")), enc.encodeToString(spec(pair.getPrivate(), "PKCS8EncodedKeySpec"))


def sign(spark: SparkSession, text: str, private: str) -> str:
    jvm = spark._jvm
    spec = jvm.java.security.spec.PKCS8EncodedKeySpec(jvm.java.util.Base64.getDecoder().decode(private))
    s = jvm.java.security.Signature.getInstance("Ed25519")
    s.initSign(jvm.java.security.KeyFactory.getInstance("Ed25519").generatePrivate(spec))
    s.update(bytearray(text.encode()))
    return jvm.java.util.Base64.getEncoder().encodeToString(s.sign())


def verify(spark: SparkSession, text: str, signature: str, public: str) -> bool:
    jvm = spark._jvm
    dec = jvm.java.util.Base64.getDecoder()
    try:
        s = jvm.java.security.Signature.getInstance("Ed25519")
        s.initVerify(jvm.java.security.KeyFactory.getInstance("Ed25519").generatePublic(jvm.java.security.spec.X509EncodedKeySpec(dec.decode(public))))
        s.update(bytearray(text.encode()))
        return bool(s.verify(dec.decode(signature)))
    except Exception as error:  # a key or signature that does not parse is no proof
        if "java.security" in str(error) or "IllegalArgument" in str(error):
            return False
        raise


@F.pandas_udf(StringType())
def vector_id(vectors: pd.Series) -> pd.Series:
    """SHA-256 of the little-endian float32 bytes of each vector."""
    return vectors.map(lambda v: None if v is None else hashlib.sha256(np.asarray(v, "<f4").tobytes()).hexdigest())

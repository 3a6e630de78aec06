"""The functions that no built-in covers, as vectorised pandas UDFs: map projection and signed tokens."""

from __future__ import annotations

import base64
import hashlib
import hmac

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: The Krovak projection on the Bessel ellipsoid and its shift to WGS 84 (position vector).
BESSEL_A, BESSEL_F = 6377397.155, 1 / 299.1528128
WGS_A, WGS_F = 6378137.0, 1 / 298.257223563
LAT0, LON0, ALPHA, SCALE, PARALLEL = np.radians(49.5), np.radians(24 + 50 / 60), np.radians(30 + 17 / 60 + 17.30311 / 3600), 0.9999, np.radians(78.5)
SHIFT, TURN, GROW = np.array([570.8, 85.7, 462.8]), np.radians(np.array([4.998, 1.587, 5.261]) / 3600), 3.56e-6


def krovak(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Latitude and longitude (WGS 84) of negative Krovak east-north coordinates."""
    e2 = BESSEL_F * (2 - BESSEL_F)
    e = np.sqrt(e2)
    a = BESSEL_A * np.sqrt(1 - e2) / (1 - e2 * np.sin(LAT0) ** 2)
    b = np.sqrt(1 + e2 * np.cos(LAT0) ** 4 / (1 - e2))
    g0 = np.arcsin(np.sin(LAT0) / b)
    t0 = np.tan(np.pi / 4 + g0 / 2) * ((1 + e * np.sin(LAT0)) / (1 - e * np.sin(LAT0))) ** (e * b / 2) / np.tan(np.pi / 4 + LAT0 / 2) ** b
    n, r0 = np.sin(PARALLEL), SCALE * a / np.tan(PARALLEL)
    south, west = -np.asarray(y, float), -np.asarray(x, float)
    r, theta = np.hypot(south, west), np.arctan2(west, south)
    d = theta / n
    t = 2 * (np.arctan((r0 / r) ** (1 / n) * np.tan(np.pi / 4 + PARALLEL / 2)) - np.pi / 4)
    u = np.arcsin(np.cos(ALPHA) * np.sin(t) - np.sin(ALPHA) * np.cos(t) * np.cos(d))
    v = np.arcsin(np.cos(t) * np.sin(d) / np.cos(u))
    lon, lat = LON0 - v / b, u
    for _ in range(8):
        lat = 2 * (np.arctan(t0 ** (-1 / b) * np.tan(u / 2 + np.pi / 4) ** (1 / b) * ((1 + e * np.sin(lat)) / (1 - e * np.sin(lat))) ** (e / 2)) - np.pi / 4)
    # To the other ellipsoid: cartesian, turned, grown and shifted.
    radius = BESSEL_A / np.sqrt(1 - e2 * np.sin(lat) ** 2)
    p = np.array([radius * np.cos(lat) * np.cos(lon), radius * np.cos(lat) * np.sin(lon), radius * (1 - e2) * np.sin(lat)])
    rx, ry, rz = TURN
    m = np.array([[1, -rz, ry], [rz, 1, -rx], [-ry, rx, 1]])
    px, py, pz = (1 + GROW) * np.tensordot(m, p, 1) + SHIFT.reshape(3, *[1] * (p.ndim - 1))
    w2 = WGS_F * (2 - WGS_F)
    lon, flat = np.arctan2(py, px), np.hypot(px, py)
    lat = np.arctan2(pz, flat * (1 - w2))
    for _ in range(8):
        big = WGS_A / np.sqrt(1 - w2 * np.sin(lat) ** 2)
        lat = np.arctan2(pz + w2 * big * np.sin(lat), flat)
    return np.round(np.degrees(lat), 6), np.round(np.degrees(lon), 6)


def krovak_udf():
    @F.pandas_udf("latitude double, longitude double")
    def convert(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        lat, lon = krovak(x.to_numpy(), y.to_numpy())
        return pd.DataFrame({"latitude": lat, "longitude": lon})

    return convert


def _encode(raw: bytes) -> str:
    return base64.urlsafe_b64encode(raw).decode().rstrip("=")


def sign(payload: str, secret: str) -> str:
    """``payload.signature``, both in URL-safe base 64."""
    return f"{_encode(payload.encode())}.{_encode(hmac.new(secret.encode(), payload.encode(), hashlib.sha256).digest())}"


def verify(token: str | None, secret: str) -> str | None:
    """The payload of a token that this secret signed, else None."""
    try:
        body, _ = (token or "").split(".")
        payload = base64.urlsafe_b64decode(body + "=" * (-len(body) % 4)).decode()
    except ValueError:
        return None
    return payload if hmac.compare_digest(sign(payload, secret), token or "") else None


def signer(secret: str):
    @F.pandas_udf("string")
    def run(payloads: pd.Series) -> pd.Series:
        return payloads.map(lambda x: sign(x, secret), na_action="ignore")

    return run


def verifier(secret: str):
    @F.pandas_udf("string")
    def run(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda x: verify(x, secret))

    return run

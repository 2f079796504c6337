"""General detectors: identity, finance, contact, health, location and secrets in context."""

from __future__ import annotations

from lakewarden.functions.detector import Detector

#: Identifier, label, category, severity and pattern of each detector.
GENERAL: tuple[Detector, ...] = (
    Detector("IN_AADHAAR_CANDIDATE", "AADHAAR", "GOVERNMENT_IDENTIFIER", "CRITICAL", r"(?<!\d)[2-9](?:[ -]?\d){11}(?!\d)", validator="aadhaar"),
    Detector("IN_PAN", "PAN", "GOVERNMENT_IDENTIFIER", "HIGH", "(?<![A-Z0-9])[A-Z]{5}[0-9]{4}[A-Z](?![A-Z0-9])", flags="i"),
    Detector("IN_DRIVING_LICENSE_CONTEXT", "DL", "DRIVING_IDENTIFIER", "HIGH", r"\b(?:driving\s+licen[cs]e|dl\s*(?:no|number|#)?)\s*[:#\-]?\s*([A-Z]{2}\s*[-/]?\s*\d{2}\s*[-/]?\s*\d{4,11})\b", flags="i", group=1),
    Detector("IN_PASSPORT_CONTEXT", "PASSPORT", "GOVERNMENT_IDENTIFIER", "HIGH", r"\bpassport\s*(?:no|number|#)?\s*[:#\-]?\s*([A-Z][0-9]{7})\b", flags="i", group=1),
    Detector("IN_VOTER_EPIC_CONTEXT", "VOTER_ID", "GOVERNMENT_IDENTIFIER", "HIGH", r"\b(?:voter\s*(?:id|number)?|epic)\s*[:#\-]?\s*([A-Z]{3}[0-9]{7})\b", flags="i", group=1),
    Detector("IN_PASSPORT_BARE_CANDIDATE", "PASSPORT", "GOVERNMENT_IDENTIFIER", "MEDIUM", "(?<![A-Z0-9])[A-Z][0-9]{7}(?![A-Z0-9])", low=True),
    Detector("IN_BANK_ACCOUNT_CONTEXT", "BANK_ACCOUNT", "FINANCIAL_IDENTIFIER", "CRITICAL", r"\b(?:bank\s*)?(?:account|a/c|acct)\s*(?:no|number|#)?\s*[:\-]?\s*([0-9]{9,18})\b", flags="i", group=1),
    Detector("IN_IFSC", "IFSC", "FINANCIAL_IDENTIFIER", "HIGH", "(?<![A-Z0-9])[A-Z]{4}0[A-Z0-9]{6}(?![A-Z0-9])", flags="i"),
    Detector("IN_MICR", "MICR", "FINANCIAL_IDENTIFIER", "MEDIUM", r"\b(?:micr|micr\s*code|cheque\s*(?:no|number|code)?)\s*[:#-]?\s*([0-9]{9})\b", flags="i", group=1),
    Detector("PAYMENT_CARD_CANDIDATE", "PAYMENT_CARD", "FINANCIAL_IDENTIFIER", "CRITICAL", r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)", validator="luhn"),
    Detector("PAYMENT_CVV_CONTEXT", "CVV", "AUTHENTICATION_SECRET", "CRITICAL", r"\b(?:cvv|cvc|security\s*code)\s*[:#-]?\s*(\d{3,4})\b", flags="i", group=1, secret=True),
    Detector("EMAIL", "EMAIL", "CONTACT_PII", "HIGH", r"\b[A-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?(?:\.[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?)+\b", flags="i"),
    Detector("IN_UPI_ID", "UPI_ID", "FINANCIAL_IDENTIFIER", "HIGH", r"\b[a-zA-Z0-9][a-zA-Z0-9._-]{1,255}@[a-zA-Z][a-zA-Z0-9.-]{1,63}\b"),
    Detector("IN_GSTIN", "GSTIN", "BUSINESS_IDENTIFIER", "MEDIUM", "(?<![A-Z0-9])[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][A-Z0-9]Z[A-Z0-9](?![A-Z0-9])", flags="i"),
    Detector("IN_CIN", "CIN", "BUSINESS_IDENTIFIER", "MEDIUM", "(?<![A-Z0-9])[LU][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6}(?![A-Z0-9])", flags="i"),
    Detector("IN_VEHICLE_REGISTRATION", "VEHICLE_REG", "VEHICLE_IDENTIFIER", "MEDIUM", "(?<![A-Z0-9])[A-Z]{2}[ -]?[0-9]{1,2}[ -]?[A-Z]{1,3}[ -]?[0-9]{4}(?![A-Z0-9])", flags="i"),
    Detector("IN_PINCODE_CONTEXT", "PINCODE", "CONTACT_PII", "LOW", r"\b(?:pin(?:code)?|postal\s*code)\s*[:#-]?\s*([1-9][0-9]{5})\b", flags="i", group=1),
    Detector("IN_PHONE", "PHONE", "CONTACT_PII", "HIGH", r"(?<!\d)(?:\+91[ -]?)?[6-9][0-9]{4}[ -]?[0-9]{5}(?!\d)"),
    Detector("IPV4", "IPV4", "ONLINE_IDENTIFIER", "MEDIUM", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9.])"),
    Detector("MAC_ADDRESS", "MAC", "ONLINE_IDENTIFIER", "MEDIUM", "(?<![0-9a-f])(?:[0-9a-f]{2}[:-]){5}[0-9a-f]{2}(?![0-9a-f])", flags="i"),
    Detector("IPV6_CANDIDATE", "IPV6", "ONLINE_IDENTIFIER", "MEDIUM", "(?<![0-9A-Za-z:])(?:[0-9a-f]{0,4}:){2,7}[0-9a-f]{0,4}(?![0-9a-f:])", flags="i", inline=True, low=True),
    Detector("DATE_OF_BIRTH_DDMMYYYY", "DOB", "IDENTITY_ATTRIBUTE", "MEDIUM", r"(?<!\d)(?:0?[1-9]|[12][0-9]|3[01])[./-](?:0?[1-9]|1[0-2])[./-](?:19|20)[0-9]{2}(?!\d)", low=True, on=False),
    Detector("DATE_ISO", "DATE", "IDENTITY_ATTRIBUTE", "LOW", r"(?<!\d)(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?!\d)", low=True, on=False),
    Detector("US_SSN", "US_SSN", "GOVERNMENT_IDENTIFIER_GLOBAL", "CRITICAL", r"(?<!\d)(?:[0-9]{3}-[0-9]{2}-[0-9]{4})(?!\d)"),
    Detector("US_PASSPORT_CONTEXT", "US_PASSPORT", "GOVERNMENT_IDENTIFIER_GLOBAL", "HIGH", r"\b(?:passport\s*(?:no|number|#)?\s*[:#-]?\s*)([0-9]{9}|[A-Z]{1,2}[0-9]{6,9})\b", flags="i", group=1),
    Detector("UK_NINO_CONTEXT", "UK_NINO", "GOVERNMENT_IDENTIFIER_GLOBAL", "HIGH", r"\b(?:ni\s*(?:no|number)|national\s*insurance)\s*[:#-]?\s*([A-CEGHJ-PR-TW-Z]{2}[0-9]{6}[A-D])\b", flags="i", group=1),
    Detector("IBAN", "IBAN", "FINANCIAL_IDENTIFIER_GLOBAL", "HIGH", "(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]){11,30}(?![A-Z0-9])", flags="i", validator="iban"),
    Detector("SWIFT_BIC", "SWIFT_BIC", "FINANCIAL_IDENTIFIER_GLOBAL", "MEDIUM", r"\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b", inline=True, low=True, on=False),
    Detector("AWS_ACCESS_KEY_ID", "AWS_KEY", "CREDENTIAL_SECRET", "CRITICAL", "(?<![A-Z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Z0-9])", secret=True),
    Detector("AWS_SECRET_KEY_CONTEXT", "AWS_SECRET", "CREDENTIAL_SECRET", "CRITICAL", r"\baws_secret_access_key\s*[:=]\s*([A-Za-z0-9/+=]{30,})", flags="i", group=1, secret=True),
    Detector("API_KEY_GENERIC", "API_KEY", "CREDENTIAL_SECRET", "CRITICAL", '\\b(?:api[_ -]?key|apikey)\\b\\s*[:=]\\s*["\']?([A-Za-z0-9_\\-]{16,})["\']?', flags="i", group=1, secret=True),
    Detector("JWT", "JWT", "CREDENTIAL_SECRET", "CRITICAL", r"\beyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\b", secret=True),
    Detector("PRIVATE_KEY_HEADER", "PRIVATE_KEY", "CREDENTIAL_SECRET", "CRITICAL", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----[\s\S]*?(?:-----END (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----)?", secret=True),
    Detector("PASSWORD_CONTEXT", "PASSWORD", "AUTHENTICATION_SECRET", "CRITICAL", r"\b(?:password|passwd|pwd)\b\s*[:=]\s*([^\s,;]{4,})", flags="i", group=1, secret=True),
    Detector("OTP_CONTEXT", "OTP", "AUTHENTICATION_SECRET", "CRITICAL", r"\b(?:otp|one[- ]time\s*password|verification\s*code)\b\s*(?:is|:)?\s*(\d{4,8})\b", flags="i", group=1, secret=True),
    Detector("PRIVATE_TOKEN_BEARER", "BEARER_TOKEN", "CREDENTIAL_SECRET", "CRITICAL", r"\bBearer\s+([A-Za-z0-9._~+/=-]{20,})\b", flags="i", group=1, secret=True),
    Detector("CRYPTO_PRIVATE_KEY_GENERIC", "SECRET_KEY", "CREDENTIAL_SECRET", "CRITICAL", r"\b(?:private[_ -]?key|secret[_ -]?key)\b\s*[:=]\s*([A-Za-z0-9+/=_-]{16,})\b", flags="i", group=1, secret=True),
    Detector("HEALTH_CONTEXT", "HEALTH", "HEALTH_DATA", "HIGH", r"\b(?:diagnosis|medical\s*record|patient\s*id|prescription|medication|blood\s*group|hospital\s*id)\b\s*[:#=-]\s*([^\n,;]{2,60})", flags="i", group=1, inline=True),
    Detector("BIOMETRIC_CONTEXT", "BIOMETRIC", "BIOMETRIC_DATA", "CRITICAL", r"\b(?:biometric|fingerprint|face\s*(?:template|scan)|iris\s*(?:scan|template)|retina|voiceprint|facial\s*embedding)[\s_-]*(?:data|template|hash|id|value|vector)?\s*[:=]\s*([^\s,;]{6,})", flags="i", group=1),
    Detector("PRECISE_LOCATION_COORDS", "GEO_COORDS", "LOCATION_DATA", "HIGH", r"\b(?:lat(?:itude)?|latitude)\s*[:=]\s*[+-]?(?:90(?:\.0+)?|[0-8]?\d(?:\.\d+)?)\s*[,; ]+\s*(?:lon(?:gitude)?|longitude)\s*[:=]\s*[+-]?(?:180(?:\.0+)?|1[0-7]\d(?:\.\d+)?|[0-9]?\d(?:\.\d+)?)\b", flags="i"),
)

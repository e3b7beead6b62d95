import random

WORDS = [a + b + c for a in ("ba", "ko", "ti", "lu", "re") for b in ("ma", "so", "ni", "pe", "du") for c in ("r", "st", "l", "n", "")]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(50)) if rng.random() < 0.3 else "") for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, _gone string, _l long, _y int, _spans int, _new int, _cut_id int, tie long"


def table(spark, rows, source="s"):
    """documents of (doc_id, text), with further columns whose names operators use inside."""
    return spark.createDataFrame([(d, t, "en", source, len(t) if t is not None else None, 1, "g", 2, 3, 4, 5, 6, 7) for d, t in rows], SCHEMA)

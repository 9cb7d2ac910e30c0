"""Small tables with the odd cases: nulls, blanks, copies, ties, runs of white space, a long text, clashing columns."""

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text(k: int, n: int = 60) -> str:
    return " ".join(WORDS[(k * 7 + j * j + j * (k % 5 + 1)) % 20] + str((k * j) % 13) for j in range(n))


TEXTS = {
    0: None, 1: "", 2: "   \n\t ", 3: "one", 4: "One two THREE", 5: text(5), 6: text(5), 7: text(5).upper(), 8: text(8, 3000), 9: "naïve café 中文 😀 <|endoftext|>  double  spaces\r\n\tx",
    10: text(10) + " tail", 11: text(10) + " other", 12: "a" * 5000, 13: "\x00\x01 control", 14: text(5), 15: "été ÉTÉ straße Σίσυφος W̊",
}


def documents(spark):
    rows = [(k, t, "en", "s", None if t is None else len(t), "clash", 1, 2) for k, t in TEXTS.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, body string, bucket_no int, label int")


def write(spark, path, docs, **tables):
    docs.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)

from sumire.plans import layout as plans


def test_stacked_runs_keep_whole_lines_and_stack_single_characters(spark, tmp_path):
    def line(i, text, y, image="p"):
        return (i, image, "s.pdf", 1, 0, text, "horizontal", 0, "F", [10.0, y, 20.0, y + 10.0])

    rows = [line(1, "縦", 0.0), line(2, "書", 10.0), line(3, "き", 20.0), line(4, "長い行", 30.0), line(5, "次の行", 40.0), line(6, "三の行", 50.0), line(7, "字", 60.0), line(8, None, 0.0, "q"), line(9, "x", 0.0, None)]
    schema = "line_id long, image string, source_pdf string, page int, source_block int, text string, orientation string, wmode int, font_name string, bbox array<double>"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/page_lines.parquet")
    got = [(r.text, r.lines, r.orientation) for r in plans.stacked_runs(spark, tmp_path).orderBy("page", "line").collect()]
    assert got == [("縦書き", 3, "vertical"), ("長い行", 1, "horizontal"), ("次の行", 1, "horizontal"), ("三の行", 1, "horizontal"), ("字", 1, "horizontal"), ("", 1, "horizontal")]

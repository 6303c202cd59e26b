from pageloom.operators.prompts import NO_CONTENT, ask_all, extraction_prompts, page_lengths, qa_answers, qa_prompts, qa_requests


def pages(spark):
    return spark.createDataFrame([(1, "Designing Data-Intensive Applications, $40"), (2, " \n"), (3, None)], "page_id int, clean_text string")


def test_extraction_prompt_holds_goal_and_cut_text(spark):
    prompt = extraction_prompts(pages(spark), "All books", max_text=9).where("page_id = 1").first().prompt
    assert "GOAL: All books" in prompt and prompt.endswith("<webpage>\nDesigning\n</webpage>")


def test_blank_pages_get_no_prompt(spark):
    prompts = qa_prompts(ask_all(pages(spark), ["Which book?", "Price?"])).orderBy("question_id").collect()
    assert [(p.page_id, p.question_id, p.content_length) for p in prompts] == [(1, 0, 42), (1, 1, 42)]
    assert prompts[1].prompt.endswith("QUESTION:\nPrice?")


def test_answers(spark):
    questions = spark.createDataFrame([(1, 1, "a?"), (1, 2, "b?"), (1, 3, "c?"), (2, 1, "d?"), (3, 1, "e?")], "page_id int, question_id int, question string")
    responses = spark.createDataFrame([(1, 1, " It is on data. \n", None), (1, 2, None, "quota")], "page_id int, question_id int, text string, error string")
    got = qa_answers(qa_requests(pages(spark), questions), responses, "some-model").collect()
    assert {(r.page_id, r.question_id): (r.answer, r.content_length, r.success, r.error_message) for r in got} == {
        (1, 1): ("It is on data.", 42, True, None), (1, 2): ("", 42, False, "quota"), (1, 3): ("", 42, False, "No response was recorded."),
        (2, 1): (NO_CONTENT, 0, True, None), (3, 1): (NO_CONTENT, 0, True, None),
    }


def test_repeated_responses_and_null_keys_give_one_answer(spark):
    questions = spark.createDataFrame([(1, 1, "a?"), (1, None, "b?"), (1, 3, "c?")], "page_id int, question_id int, question string")
    rows = [(1, 1, None, "quota"), (1, 1, "b", None), (1, 1, "a", None), (1, None, "n", None), (1, None, "n", None), (1, 3, None, "x"), (1, 3, None, "w")]
    responses = spark.createDataFrame(rows, "page_id int, question_id int, text string, error string").repartition(4)
    requests = qa_requests(pages(spark), questions)
    got = {r.question_id: (r.answer, r.success, r.error_message) for r in qa_answers(requests, responses, "m").collect()}
    assert got == {1: ("a", True, None), None: ("n", True, None), 3: ("", False, "w")}
    assert qa_answers(requests, responses, "m").count() == 3


def test_answers_from_lengths_equal_those_from_texts(spark):
    questions = spark.createDataFrame([(p, q, "?") for p in (1, 2, 3) for q in (1, 2)], "page_id int, question_id int, question string")
    responses = spark.createDataFrame([(1, 1, "yes", None), (2, 1, "no", None)], "page_id int, question_id int, text string, error string")
    by_text = qa_answers(qa_requests(pages(spark), questions), responses, "m", max_text=9)
    by_length = qa_answers(qa_requests(page_lengths(pages(spark), max_text=9), questions), responses, "m")
    assert sorted(map(tuple, by_text.collect())) == sorted(map(tuple, by_length.collect()))

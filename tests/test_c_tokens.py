import pytest

from corvane.functions import c_tokens as ct

SAMPLE = """int copy_in(char *dst, const char *src, int max_len) {
    char local[256];
    int n = strlen(src);
    if (n > 0 && n < max_len) {
        strcpy(local, src);
        printf("copied %d\\n", n);
    }
    char *heap = malloc(1024);
    if (heap == NULL) return -1;
    memcpy(heap, local, n);
    dst[0] = heap[0]; /* keep */ // done
    free(heap);
    return 0;
}"""


def test_optimized_keeps_calls_keywords_and_operators():
    got = set(ct.optimized(SAMPLE))
    assert {"malloc", "free", "memcpy", "strcpy", "strlen", "void", "char", "int", "if", "return", "NULL"} - got == {"void"}
    assert {"=", "==", "<", ">", "&&", "NEG_1", "STR", "256", "1024", "BUF_0", "LEN_0"} <= got
    assert any(t.startswith("VAR_") or t.startswith("MEM_") for t in got)


def test_families_defences_and_other_calls():
    assert ct.optimized("av_malloc(n); av_freep(&p); av_frame_unref(f); memcpy(a, b, n);")[0] == "API_ALLOC"
    got = ct.optimized("kfree(x); object_unref(o); validate_user(u); my_thing(z); s->free(q);")
    assert [t for t in got if t.isupper() and "_" in t or t == "FUNC"][:4] == ["API_FREE", "VAR_0", "API_UNREF", "VAR_1"]
    assert "DEF_CHECK" in got and "FUNC" in got


@pytest.mark.parametrize(("code", "want"), [("0", "0"), ("256", "256"), ("12345", "NUM"), ("0xFFu", "0xff"), ("0x123", "NUM_HEX"), ("0644", "PERM_0644"), ("0123", "NUM_OCT"), ("1.5f", "FLOAT"), ("65535", "65535"), ("'c'", "CHAR"), ('"s"', "STR"), ("[SEP]", "SEP")])
def test_literals(code, want):
    assert ct.optimized(code) == [want]


def test_signs_and_subtraction():
    assert ct.optimized("return -1;") == ["return", "NEG_1", ";"]
    assert ct.optimized("a -1") == ["VAR_0", "-", "1"]
    assert ct.optimized("(uint8_t) -1") == ["(", "uint8_t", ")", "NEG_1"]
    assert ct.optimized("f(x) - 1")[-2:] == ["-", "1"]


def test_numbering_starts_anew_overflows_and_saturates():
    many = " ".join(f"zq{chr(97 + i // 26)}{chr(97 + i % 26)}x;" for i in range(45))
    got = [t for t in ct.optimized(many) if t != ";"]
    assert got[39] == "VAR_39" and set(got[40:]) == {"VAR_OVF"}
    assert [t for t in ct.canonical(many) if t != ";"][-1] == "VAR_31"
    assert ct.optimized("foo_q") == ct.optimized("bar_q") == ["VAR_0"]
    assert ct.optimized("buf; buf2; buf", indexed=False) == ["BUF", ";", "BUF", ";", "BUF"]


def test_hybrid_canonical_and_normalized():
    assert ct.hybrid("x = malloc(len) + helper(y) + check_len(z);") == ["ID", "=", "malloc", "(", "ID", ")", "+", "FUNC", "(", "ID", ")", "+", "check_len", "(", "ID", ")", ";"]
    assert ct.normalized("int a = f(b); a = f(a);") == ["int", "VAR_0", "=", "FUNC_0", "(", "VAR_1", ")", ";", "VAR_0", "=", "FUNC_0", "(", "VAR_0", ")", ";"]
    assert ct.preserve("ctx->buf[300] = 'x';") == ["ctx", "->", "buf", "[", "NUM", "]", "=", "CHAR", ";"]


def test_subtokens():
    assert ct.subtokens("h264_filter_mbFast") == ["h", "IDNUM", "filter", "mb", "fast"]
    assert ct.subtokens("HTTPConnection_x2") == ["http", "connection", "x", "2"]
    assert ct.subtoken("CONFIG_GRAY = a_b_c_d_e_f_g_h_i_j;") == ["config", "gray", "=", *"abcdefgh", ";"]
    assert ct.subtoken("n = 300 + 70000 + 5000000000;") == ["n", "=", "NUM_16BIT", "+", "NUM_32BIT", "+", "NUM_LARGE", ";"]


@pytest.mark.parametrize(("text", "want"), [("select a from b", "SQL_STR"), ("https://x.y", "URL_STR"), ("www.site.org", "URL_STR"), ("/etc/hosts", "PATH_STR"), ("my password", "CRED_STR"), ("a@b.c", "EMAIL_STR"), ("10.0.0.1", "IP_STR"), ("a[0-9]b", "REGEX_STR"), ("plain", "STR"), ("%d", "STR")])
def test_string_categories(text, want):
    assert ct.string_word(f'"{text}"') == want


def test_pandas_udf_gives_the_same(spark):
    df = spark.createDataFrame([(1, SAMPLE), (2, None), (3, "")], "id long, code string")
    for policy, f in ct.POLICIES.items():
        got = {r.id: r.t for r in df.select("id", ct.tokenized(df["code"], policy).alias("t")).collect()}
        assert got == {1: f(SAMPLE), 2: [], 3: []}

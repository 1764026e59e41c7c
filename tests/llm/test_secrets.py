"""The lexer of secrets: planted cases of many syntaxes, clean ones, and time on long lines."""

import time

import pytest

from strandline.llm import secrets

KEY = "Zq8$kfP2!mW7#rT9"
PLANTED = [
    f'client_secret = "{KEY}"', f"db:\n  pwd: '{KEY}'\n", f'{{"auth_token": "{KEY}", "n": 1}}', rf'{{\"auth_token\": \"{KEY}\"}}',
    f'let dbPassword: string = "{KEY}";', f'password: Optional[str] = "{KEY}"', f'private static final String API_KEY = "{KEY}";', f'var password string = "{KEY}"',
    f'PASSWORD = (\n    "{KEY}"\n)', f'secret_key = \\\n    "{KEY}"', f'secret = """{KEY}"""', f"token = r'{KEY}'", f"const token = `{KEY}`",
    f"export DB_PWD={KEY}", f"db_pwd={KEY}  # for tests", f"db.password: {KEY}", f"password: |\n  {KEY}\n", "db_pwd=correcthorsebattery", "db_pwd=s3cr3t!x9zQ",
    f"<password>{KEY}</password>", f'<add key="ApiKey" value="{KEY}"/>', f'<entry key="db.password">{KEY}</entry>', f'<db password="{KEY}" user="x"/>',
    f'config["password"] = "{KEY}"', f'conf.set("db.password", "{KEY}")', f'client.setPassword("{KEY}")', f"mysql --password {KEY}", f"run --api-key={KEY}",
    f'x = "{KEY}"\nclient_secret = x', f'client_secret = x\nx = "{KEY}"', f'a = "{KEY}"\nb = a\nself.auth_token = b', f"password => '{KEY}'",
]
CLEAN = [
    'greeting = "hello there, world"', f'monkey = "{KEY}"', 'password = ""', "password = getpass.getpass()", 'secret = os.environ["SECRET_NAME"]', "token: str", "password = None",
    "token_url = https://example.org/oauth/authorize", "Enter your password: then press return", "if token == other_token_value_1:", "password=${DB_PASSWORD_1}", 'password = "please enter your password here"',
    "secret_file = /etc/ssl/private/server1.pem", "The key: a short story about keys",
]


@pytest.mark.parametrize("text", PLANTED)
def test_planted_secrets_are_found(text):
    found = [text[a:b] for a, b in secrets.lexed(text)]
    assert found in ([KEY], ["correcthorsebattery"], ["s3cr3t!x9zQ"])


@pytest.mark.parametrize("text", CLEAN)
def test_clean_lines_have_no_secret(text):
    assert secrets.lexed(text) == []


def test_concatenated_literals_are_one_value():
    text = 'token = prefix + "Zq8$kfP2" + "!mW7#rT9"\nprefix = "live_x1_"'
    assert [text[a:b] for a, b in secrets.lexed(text)] == ["Zq8$kfP2", "!mW7#rT9", "live_x1_"]


@pytest.mark.parametrize("unit", ['\\"', '"', "'", "a=", 'a="\\"', "a='''", "key: ", '{\\"a\\": \\"b\\", ', "password = ", "<a ", "<a>", "f(", "--a ", "a.", " ", "\n", "=", 'x="', "`", "a=`", "password" + " " * 50, "a + ", 'a=("', "é=", "name='a' "])
def test_time_grows_with_the_length(unit):
    def took(n):
        text, began = unit * (n // len(unit)), time.process_time()
        secrets.scan_text(text)
        return time.process_time() - began

    assert took(1 << 18) < 4 * took(1 << 16) * 2 + 0.3

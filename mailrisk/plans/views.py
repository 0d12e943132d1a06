"""Mail and log tables derived from the provided test tables.

The tables hold no mail, so each document becomes the body of a message in one of
eight variants, and each event becomes a log record.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailrisk.functions.common import strings
from mailrisk.schemas import ATTACHMENT

_LINKS = "".join(
    f'<p><a href="https://host{i}.example.org/p?i={i}">go</a></p>' for i in range(1, 13)
)

# headers, text put before the document, HTML, attachments (name, type, size);
# ``{id}`` stands for the document id
VARIANTS = [
    (
        "From: PayPal Support <help@paypa1-center.com>\nTo: user{id}@example.com\n"
        "Subject: Urgent notice\nAuthentication-Results: mx.example.com;\n"
        " spf=fail smtp.mailfrom=paypa1-center.com;\n dkim=fail;\n"
        " dmarc=fail policy.reject; end",
        "Urgent: click here to verify your account within 24 hours!! Your account has"
        " been suspended. See http://paypa1-center.com/verify-account\n",
        '<html><head><style>p {color:red}</style></head><body><p>Notice</p>'
        '<a class="b" href="http://paypa1-center.com/verify?id={id}&amp;s=1">verify</a>'
        "</body></html>",
        [],
    ),
    (
        "From: Banco Santander <avisos@clientes-{id}.tk>\nTo: cliente@empresa.com\n"
        "Reply-To: Soporte <soporte@otro-sitio.net>\nSubject: Datos\n"
        "Received-SPF: softfail (transition)",
        "Estimado cliente de Santander, su contraseña caduca hoy. Debe confirmar identidad en las"
        " últimas 2 horas, acceso bloqueado.\n",
        "<body><form action='https://acceso-seguro-banco.tk/login'>"
        "<img src=\"https://www.example.net/logo.png\"></form></body>",
        [("formulario.exe", "application/x-executable", 2048000)],
    ),
    (
        "From: Finanzas <pagos@consultoria.com>\nTo: empleado@empresa.com\n"
        "Subject: Factura {id}\nX-Forwarded-For: 203.0.113.9",
        "Necesitamos verificar la cuenta 123456 para transferir el pago de la factura."
        " Escriba a cobros{id}@consultoria.com o llame al 555-123-4567.\n",
        "",
        [("factura.pdf", "application/pdf", 45678)],
    ),
    (
        "From: IT Department <it@helpdesk-alerts.net>\nTo: user@example.com\n"
        "Authentication-Results: mx.example.com; spf=softfail; dkim=none",
        "We detected suspicious activity &amp; more?! Unauthorized attempt from a new device, the"
        " session expires in 30 minutes. We was told these data are an information.\n",
        '<p>Review <a href="http://10.0.0.{id}/x">here</a> or '
        '<a href="https://bit.ly/a{id}">here</a></p><script>var a = 1;\nrun(a);</script>',
        [("empty.txt", "text/plain", 0)],
    ),
    (
        'From: "PayPal" <service@paypal.com>\nTo: user@example.com\n'
        "DKIM-Signature: v=1; a=rsa-sha256; d=paypal.com; s=k1\n"
        "Authentication-Results: mx.example.com; spf=pass; dkim=pass; dmarc=pass",
        "Thank you for your PayPal payment at Amazon. Card 4111-1111-1111-1111 was charged, receipt"
        " number {id}.\n",
        '<a href="https://www.paypal.com/receipt/{id}">Receipt</a>',
        [],
    ),
    (
        "From: hr@example.com (Human Resources)\nTo: all@example.com\n"
        "Authentication-Results: mx.example.com; spf=pass; dkim=pass; dmarc=pass\n"
        "Received: from mail.example.com by mx.example.com for all@example.com",
        "Meeting moved to Monday at ten, bring the notes.\n",
        "",
        [("archive.zip", "application/zip", 60000000)],
    ),
    (
        "From: Apple <no-reply@xn--appl-yva.com>\nTo: user@example.com\n"
        "Received: from relay.tk ([127.0.0.1])\n by mx1.example.com; Mon\n"
        "Received: from localhost ([192.168.1.1])\n by relay.tk; Mon\n"
        "X-Real-IP: 198.51.100.{id}",
        "Enter your Apple password and confirm identity right now, last 2 hours.\n",
        f"<div>{_LINKS}</div>",
        [],
    ),
    ("", "", "", []),
]
EMPTY_VARIANT = len(VARIANTS) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mail_of(documents: DataFrame) -> DataFrame:
    """One message per document; the last variant is an empty message."""
    variant = F.pmod(F.col("doc_id"), F.lit(len(VARIANTS))).cast("int")

    def pick(values):
        return F.get(F.array(*values), F.col("v"))

    def filled(part):
        return F.replace(
            pick([F.lit(v[part]) for v in VARIANTS]), F.lit("{id}"), F.col("doc_id").cast("string")
        )

    def files(variant):
        rows = [
            F.struct(
                F.lit(name).alias("filename"),
                F.lit(mime).alias("mime"),
                F.lit(size).cast("bigint").alias("size"),
                F.lit("").alias("hash"),
            )
            for name, mime, size in variant[3]
        ]
        return F.array(*rows).cast(f"array<{ATTACHMENT.simpleString()}>")

    body = F.when(F.col("v") == EMPTY_VARIANT, "").otherwise(
        F.concat(filled(1), F.col("text"))
    )
    return documents.withColumn("v", variant).select(
        F.col("doc_id").alias("message_id"),
        "lang",
        filled(0).alias("raw_headers"),
        filled(2).alias("raw_html"),
        body.alias("text_body"),
        pick([files(v) for v in VARIANTS]).alias("attachments"),
        F.struct(
            F.when(F.col("lang") == "en", "en-US").alias("user_locale"),
            F.when(F.col("v") == 4, strings(["service@paypal.com"])).alias(
                "trusted_senders"
            ),
            strings(["example.com", "empresa.com"]).alias("owned_domains"),
        ).alias("context"),
    )


def mail_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail_of(table(spark, sf_dir, "documents"))


def log_of(events: DataFrame) -> DataFrame:
    """One log record per event."""
    kind, number = F.col("event_type"), F.col("event_id")
    turn = F.pmod(number, F.lit(3))
    failed = kind == "error"
    endpoint = F.when(kind == "view", "/health").otherwise("/classify")
    status = F.when(failed, F.element_at(F.array(*map(F.lit, (500, 400, 401))), (turn + 1).cast("int"))).otherwise(200)
    error_type = F.when(
        failed,
        F.element_at(
            strings(["internal_error", "invalid_request", "authentication_failed"]),
            (turn + 1).cast("int"),
        ),
    )
    digit = F.pmod(number, F.lit(10))
    classified = F.when(
        (kind != "error") & (kind != "view"),
        F.when(digit < 2, "phishing").when(digit < 5, "sospechoso").otherwise("seguro"),
    )
    return events.select(
        "event_id",
        "ts",
        F.when(failed, "ERROR").otherwise("INFO").alias("level"),
        F.when(failed, "Classification failed").otherwise("HTTP request processed").alias(
            "event"
        ),
        F.when(kind == "view", "GET").otherwise("POST").alias("method"),
        endpoint.alias("endpoint"),
        status.cast("int").alias("status"),
        F.floor(F.col("value") * 20).cast("bigint").alias("duration_ms"),
        error_type.alias("error_type"),
        F.when(kind == "purchase", "reviewer").otherwise("api").alias("component"),
        classified.alias("classification"),
        F.least(
            F.get_json_object("props", "$.k").cast("int"), F.lit(100)
        ).alias("risk_score"),
        F.concat(F.lit("10.0.0."), F.pmod("user_id", F.lit(50)).cast("string")).alias(
            "remote_ip"
        ),
    )


def log_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_of(table(spark, sf_dir, "events"))


# Gauges an event can stand for; ``deployment_failed`` and ``restarts`` count.
GAUGES = [
    "up", "cpu_pct", "memory_used", "memory_limit", "restarts", "deployment_failed",
    "uptime_check",
]


def gauge_of(events: DataFrame) -> DataFrame:
    """One gauge sample per event."""
    metric = F.get(strings(GAUGES), F.pmod("event_id", F.lit(len(GAUGES))).cast("int"))
    value = F.col("value")
    return events.select(
        "ts",
        metric.alias("metric"),
        F.concat(F.lit("i"), F.pmod("user_id", F.lit(3)).cast("string")).alias("instance"),
        F.when(metric.isin("up", "uptime_check"), (value > 8).cast("double"))
        .when(metric == "memory_limit", F.lit(100.0))
        .when(metric.isin("restarts", "deployment_failed"), (value > 60).cast("double"))
        .otherwise(F.least(value, F.lit(100.0)))
        .alias("value"),
    )


def gauge_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gauge_of(table(spark, sf_dir, "events"))

"""Java classes of this folder as column functions: Spark's own compiler (Janino) builds them, and Spark ships them to the executors."""

from __future__ import annotations

import hashlib
import os
import pkgutil
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_MADE: dict[tuple[str, str], object] = {}


def _class(spark: SparkSession, name: str):
    """The named class in the driver, once for each Spark application; its jar goes to the executors."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _MADE:
        source = pkgutil.get_data("plaitwork.llm", f"{name}.java")
        jvm = spark._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(source.decode())
        codes = compiler.getBytecodes()
        folder = tempfile.mkdtemp(prefix="plaitwork-jar-")
        jar = os.path.abspath(os.path.join(folder, f"{name}-{hashlib.sha256(source).hexdigest()[:12]}.jar"))
        with zipfile.ZipFile(jar, "w") as f:
            for own in codes.keySet():
                f.writestr(own.replace(".", "/") + ".class", bytes(codes[own]))
        spark.sparkContext._jsc.addJar(jar)
        _MADE[key] = compiler.getClassLoader().loadClass(f"plaitwork.llm.{name}")
    return _MADE[key]


def function(spark: SparkSession, name: str, flag: bool, result: str) -> Callable[[Column], Column]:
    """A one-argument Java function: the class's constructor takes the flag, its call() the column's value."""
    sc, own = spark.sparkContext, _class(spark, name)
    kinds = sc._gateway.new_array(sc._jvm.java.lang.Class, 1)
    kinds[0] = sc._jvm.java.lang.Boolean.TYPE
    values = sc._gateway.new_array(sc._jvm.java.lang.Object, 1)
    values[0] = flag
    instance = own.getConstructor(kinds).newInstance(values)
    # the form of functions.udf() for Java functions by reflection, as py4j may take the one for Scala functions
    kinds = sc._gateway.new_array(sc._jvm.java.lang.Class, 2)
    kinds[0], kinds[1] = (sc._jvm.java.lang.Class.forName(f"org.apache.spark.sql.{k}") for k in ("api.java.UDF1", "types.DataType"))
    values = sc._gateway.new_array(sc._jvm.java.lang.Object, 2)
    values[0], values[1] = instance, spark._jsparkSession.parseDataType(f'"{result}"')
    made = sc._jvm.java.lang.Class.forName("org.apache.spark.sql.functions").getMethod("udf", kinds).invoke(None, values)
    called = f"plaitwork_{name}_{flag}".lower()
    # nondeterministic only so that Spark neither repeats the call nor puts it off into the loop of an explode
    spark._jsparkSession.udf().register(called, made.asNondeterministic())
    return lambda column: F.call_udf(called, column)


def local_files(spark: SparkSession) -> None:
    """Have this session write local files by LocalFiles.java, unless it names a class of its own for them.

    Hadoop without its native library starts a process `chmod` for each new file and each new checksum file, which for a moment
    stands beside a large executor as a second one of its size."""
    if spark.conf.get("fs.file.impl", None) or spark.sparkContext._jsc.hadoopConfiguration().get("fs.file.impl"):
        return
    own = _class(spark, "LocalFiles")
    spark.sparkContext._jsc.hadoopConfiguration().setClassLoader(own.getClassLoader())
    spark.conf.set("fs.file.impl.disable.cache", "true")  # the cache may hold Hadoop's own already
    spark.conf.set("fs.file.impl", own.getName())

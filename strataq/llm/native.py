"""The block coder of `token_files` in the JVM: the same code words as the arrays give, bit for bit.

Spark brings a Java compiler, Janino. The driver compiles SOURCE with it once a session, hands the classes to the executors
as a jar, and calls them as functions of columns. No compiler or library of the machine is needed.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import warnings
import zipfile

from py4j.protocol import Py4JError
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: One block after another, so that a block's models stay in the processor's cache.
SOURCE = r"""
package strataq;

import java.nio.ByteBuffer;
import java.nio.ByteOrder;
import java.util.Arrays;

class Models {
    static final int[] EPOCHS = {@EPOCHS@};
    static final long ONE = 1L << @BITS@;
    final int[] t1 = new int[@SLOTS1@], t2 = new int[@SLOTS2@], held = new int[@SLOTS0@ + 1], count = new int[@SLOTS0@ + 1];
    final int[] scaled = new int[@SLOTS0@ + 1], known = new int[@SLOTS0@ + 1], range = new int[@SLOTS0@ + 1];
    final long[] p1 = new long[@CONFIDENT@ + 1], p2 = new long[@CONFIDENT@ + 1];
    final long[] tried1 = new long[@CONFIDENT@ + 1], true1 = new long[@CONFIDENT@ + 1], tried2 = new long[@CONFIDENT@ + 1], true2 = new long[@CONFIDENT@ + 1];
    final short[] look = new short[1 << @COUNTS@];
    final long[] first, size, begin;
    final int[] length = new int[1 << @GRAINS@];
    final long largest;
    long low, span, code;
    int[] words;
    int at, epoch, learnt;

    /* The law of unseen ids. */
    Models(long largest) {
        this.largest = largest;
        int n = 64 - Long.numberOfLeadingZeros(largest) + 1;
        first = new long[n];
        size = new long[n];
        begin = new long[n];
        long sum = 0, from = 0;
        for (int b = 0; b < n; b++) sum += (b + 1) * (b + 1);
        int grain = 0;
        for (int b = 0; b < n; b++) {
            long grains = Math.max((long) (b + 1) * (b + 1) * (1 << @GRAINS@) / sum, 1), width = grains << (@LAW@ - @GRAINS@);
            first[b] = b > 0 ? 1L << (b - 1) : 0;
            size[b] = width / (b > 0 ? 1L << (b - 1) : 1);
            begin[b] = from;
            from += width;
            for (long k = 0; k < grains; k++) length[grain++] = b;
        }
        while (grain < length.length) length[grain++] = n - 1;
    }

    void start() {
        Arrays.fill(t1, 0);
        Arrays.fill(t2, 0);
        Arrays.fill(held, 0);
        Arrays.fill(count, 0);
        Arrays.fill(tried1, 0);
        Arrays.fill(true1, 0);
        Arrays.fill(tried2, 0);
        Arrays.fill(true2, 0);
        low = 0;
        span = -1L;
        epoch = 0;
        learnt = 0;
        settle();
    }

    void settle() {
        long total = 1, used = 1;
        int sum = 0, from = 0;
        for (int i = 0; i <= @SLOTS0@; i++) total += count[i];
        for (int i = 0; i < @SLOTS0@; i++) if (count[i] > 0) used++;
        double factor = (double) (float) ((double) ((1 << @COUNTS@) - used) / (double) total);
        for (int i = 0; i <= @SLOTS0@; i++) {
            scaled[i] = (int) ((double) count[i] * factor) + (i == @SLOTS0@ || count[i] > 0 ? 1 : 0);
            sum += scaled[i];
        }
        scaled[@SLOTS0@] += (1 << @COUNTS@) - sum;
        for (int i = 0; i <= @SLOTS0@; i++) {
            known[i] = held[i];
            range[i] = from << (@COUNTS@ + 1) | scaled[i];
            Arrays.fill(look, from, from + scaled[i], (short) i);
            from += scaled[i];
        }
        chances(p1, tried1, true1);
        chances(p2, tried2, true2);
    }

    static void chances(long[] p, long[] tried, long[] came) {
        for (int c = 1; c <= @CONFIDENT@; c++) p[c] = Math.min((2 * came[c] + 2 * c + 1 << @BITS@) / (2 * tried[c] + 2 * (@CONFIDENT@ + 3)), ONE - (ONE >> 4));
        p[0] = 0;
    }

    /* After step t of a block. */
    void learn(int[] x, int home, int t) {
        if (epoch == EPOCHS.length || t + 1 != EPOCHS[epoch]) return;
        for (int i = home + learnt; i <= home + t; i++) {
            int k = x[i] * @HASH1@ >>> @SHIFT0@;
            if (held[k] != x[i] + 1) count[@SLOTS0@]++;
            count[k]++;
        }
        for (int i = home + learnt; i <= home + t; i++) held[x[i] * @HASH1@ >>> @SHIFT0@] = x[i] + 1;
        learnt = t + 1;
        epoch++;
        settle();
    }

    /* Narrows the range; whether its upper 32 bits are due, which `due` gives. */
    boolean narrow(long begin, long size, int bits) {
        span >>>= bits;
        low += span * begin;
        span *= size;
        return span >>> 32 == 0;
    }

    int due() {
        int word = (int) (low >>> 32);
        span = Math.min(span, (1L << 32) - (low & 0xFFFFFFFFL)) << 32;
        low <<= 32;
        return word;
    }

    long point(int bits) {
        long a = code - low, b = span >>> bits, most = (1L << bits) - 1, q = a >= 0 ? a / b : Long.divideUnsigned(a, b);
        return q >= 0 && q < most ? q : most;
    }

    void encode(int[] x, int home, int steps) {
        start();
        int last = 0, last2 = 0;
        for (int t = 0; t < steps; t++) {
            int id = x[home + t], symbol = id + 1, h = last * @HASH1@, i1 = h >>> @SHIFT1@, i2 = (h ^ last2 * @HASH2@) >>> @SHIFT2@;
            int e1 = t1[i1], e2 = t2[i2], c1 = e1 & @CONFIDENT@, c2 = e2 & @CONFIDENT@, s1 = e1 >>> 4, s2 = e2 >>> 4;
            boolean hit2 = s2 == symbol, hit1 = s1 == symbol, apart = false;
            long w2 = p2[c2], from = 0, wide = w2;
            tried2[c2]++;
            if (hit2) {
                true2[c2]++;
            } else {
                long w1 = s1 != s2 ? (ONE - w2) * p1[c1] >> @BITS@ : 0;
                tried1[c1]++;
                if (hit1) {
                    true1[c1]++;
                    from = w2;
                    wide = w1;
                } else {
                    int k = id * @HASH1@ >>> @SHIFT0@;
                    long rest = ONE - w1 - w2;
                    apart = known[k] != symbol;
                    int r = range[apart ? @SLOTS0@ : k];
                    long a = r >>> @COUNTS@ + 1, b = a + (r & (2 << @COUNTS@) - 1);
                    from = a * rest >> @COUNTS@;
                    wide = (b * rest >> @COUNTS@) - from;
                    from += w1 + w2;
                }
            }
            t2[i2] = hit2 ? (c2 < @CONFIDENT@ ? e2 + 1 : e2) : symbol << 4 | 1;
            t1[i1] = hit1 ? (c1 < @CONFIDENT@ ? e1 + 1 : e1) : symbol << 4 | 1;
            if (narrow(from, wide, @BITS@)) words[at++] = due();
            if (apart) {
                int b = 32 - Integer.numberOfLeadingZeros(id);
                if (narrow(begin[b] + (id - first[b]) * size[b], size[b], @LAW@)) words[at++] = due();
            }
            last2 = last;
            last = id;
            learn(x, home, t);
        }
        words[at++] = (int) (low >>> 32);
        words[at++] = (int) low;
    }

    void decode(int[] x, int home, int steps) {
        start();
        code = (long) words[at] << 32 | words[at + 1] & 0xFFFFFFFFL;
        at += 2;
        int last = 0, last2 = 0;
        for (int t = 0; t < steps; t++) {
            int symbol, h = last * @HASH1@, i1 = h >>> @SHIFT1@, i2 = (h ^ last2 * @HASH2@) >>> @SHIFT2@;
            int e1 = t1[i1], e2 = t2[i2], c1 = e1 & @CONFIDENT@, c2 = e2 & @CONFIDENT@, s1 = e1 >>> 4, s2 = e2 >>> 4;
            long w2 = p2[c2], w1 = s1 != s2 ? (ONE - w2) * p1[c1] >> @BITS@ : 0, both = w1 + w2, from = 0, wide = w2, v = point(@BITS@);
            tried2[c2]++;
            if (v < w2) {
                symbol = s2;
                true2[c2]++;
            } else {
                tried1[c1]++;
                if (v < both) {
                    symbol = s1;
                    true1[c1]++;
                    from = w2;
                    wide = w1;
                } else {
                    long rest = ONE - both;
                    int k = look[(int) (((v - both + 1 << @COUNTS@) - 1) / rest)];
                    symbol = known[k];
                    long a = range[k] >>> @COUNTS@ + 1, b = a + (range[k] & (2 << @COUNTS@) - 1);
                    from = a * rest >> @COUNTS@;
                    wide = (b * rest >> @COUNTS@) - from;
                    from += both;
                }
            }
            if (narrow(from, wide, @BITS@)) take();
            if (symbol == 0) {
                v = point(@LAW@);
                int b = length[(int) (v >> @LAW@ - @GRAINS@)];
                long k = Math.min((v - begin[b]) / size[b], largest - first[b]);
                symbol = (int) (first[b] + k + 1);
                if (narrow(begin[b] + k * size[b], size[b], @LAW@)) take();
            }
            t2[i2] = s2 == symbol ? (c2 < @CONFIDENT@ ? e2 + 1 : e2) : symbol << 4 | 1;
            t1[i1] = s1 == symbol ? (c1 < @CONFIDENT@ ? e1 + 1 : e1) : symbol << 4 | 1;
            x[home + t] = symbol - 1;
            last2 = last;
            last = symbol - 1;
            learn(x, home, t);
        }
    }

    void take() {
        due();
        code = code << 32 | words[at++] & 0xFFFFFFFFL;
    }

    static ByteBuffer of(byte[] b) {
        return ByteBuffer.wrap(b).order(ByteOrder.LITTLE_ENDIAN);
    }

    static int[] ints(byte[] b, int n) {
        int[] x = new int[n];
        of(b).asIntBuffer().get(x, 0, b.length / 4);
        return x;
    }
}

/* (ids, largest): the words used by each block, then the words of all */
public class Encode implements org.apache.spark.sql.api.java.UDF2 {
    public Object call(Object ids, Object largest) {
        byte[] data = (byte[]) ids;
        int n = data.length / 4, steps = Math.min(@BLOCK@, n), lanes = n == 0 ? 0 : (n + @BLOCK@ - 1) / @BLOCK@;
        Models m = new Models(((Long) largest).longValue());
        int[] x = Models.ints(data, lanes * steps), used = new int[lanes];
        m.words = new int[lanes * (2 * steps + 4)];
        for (int k = 0; k < lanes; k++) {
            int before = m.at;
            m.encode(x, k * steps, steps);
            used[k] = m.at - before;
        }
        byte[] out = new byte[4 * (lanes + m.at)];
        ByteBuffer b = Models.of(out);
        b.asIntBuffer().put(used).put(m.words, 0, m.at);
        return out;
    }
}

/* (number of ids, largest, words used by each block, words): the ids */
public class Decode implements org.apache.spark.sql.api.java.UDF4 {
    public Object call(Object total, Object largest, Object used, Object words) {
        int n = ((Long) total).intValue(), steps = Math.min(@BLOCK@, n), at = 0;
        byte[] coded = (byte[]) words;
        int[] of = Models.ints((byte[]) used, ((byte[]) used).length / 4), x = new int[of.length * steps];
        Models m = new Models(((Long) largest).longValue());
        m.words = Models.ints(coded, coded.length / 4 + 2);
        for (int k = 0; k < of.length; k++) {
            m.at = at;
            m.decode(x, k * steps, steps);
            at += of[k];
        }
        byte[] out = new byte[4 * n];
        Models.of(out).asIntBuffer().put(x, 0, n);
        return out;
    }
}
"""


class Coder:
    """`encode` and `decode` as functions of columns of one session."""

    def __init__(self, spark: SparkSession, constants: dict[str, object]):
        source = SOURCE
        for name, value in constants.items():
            source = source.replace(f"@{name}@", str(value))
        jvm = spark._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(source)
        self.folder = tempfile.TemporaryDirectory(prefix="strataq-")  # as long as the driver lives
        jar = os.path.join(self.folder.name, "strataq-coder.jar")
        with zipfile.ZipFile(jar, "w") as z:
            for entry in compiler.getBytecodes().entrySet():
                z.writestr(entry.getKey().replace(".", "/") + ".class", bytes(entry.getValue()))
        spark._jsc.addJar("file://" + jar)
        loader = compiler.getClassLoader()
        none = spark.sparkContext._gateway.new_array
        binary = jvm.org.apache.spark.sql.types.DataType.fromJson('"binary"')
        for name in ("Encode", "Decode"):
            made = loader.loadClass(f"strataq.{name}").getDeclaredConstructor(none(jvm.java.lang.Class, 0)).newInstance(none(jvm.java.lang.Object, 0))
            spark._jsparkSession.udf().register(f"strataq_{name.lower()}", made, binary)

    def encode(self, ids: Column, largest: Column) -> Column:
        return F.call_function("strataq_encode", ids, largest)

    def decode(self, total: Column, largest: Column, used: Column, words: Column) -> Column:
        return F.call_function("strataq_decode", total, largest, used, words)


_coders: dict = {}


def coder(spark: SparkSession, constants: dict[str, object]) -> Coder | None:
    """The session's coder; None where the driver's JVM is out of reach, as in Spark Connect, or refuses it."""
    if not hasattr(spark, "_jsparkSession"):
        return None
    key = id(spark)
    if key not in _coders:
        try:
            made = Coder(spark, constants)
        except Py4JError as e:
            warnings.warn(f"ids are coded over arrays, which takes longer: {e}", stacklevel=2)
            made = None
        _coders[key] = spark, made  # the session is held, so that its key stays its own
    return _coders[key][1]


@contextlib.contextmanager
def own_workers(spark: SparkSession, role: str):
    """Functions made here run in Python workers of this role only: Spark shares workers among equal environments."""
    env, name = spark.sparkContext.environment, "STRATAQ_ROLE"
    before = env.get(name)
    env[name] = role
    try:
        yield
    finally:
        env.pop(name)
        if before is not None:
            env[name] = before

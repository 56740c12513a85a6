"""External symbols: system calls, C library functions, macros, the rest.

The names decide which kind a call has, so they are fixed values.  What is said
about a name follows from its group.  ``external_dimension`` takes other groups
as parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .names import col

# Names by kind and group.
SYSCALLS = {
    "File operations": """
        open openat openat2 close read write pread64 pwrite64 preadv pwritev lseek fstat stat lstat fstatat
        access faccessat dup dup2 dup3 fcntl ioctl flock fsync fdatasync truncate ftruncate fallocate readlink
        readlinkat symlink symlinkat link linkat unlink unlinkat rename renameat renameat2 mkdir mkdirat rmdir
        getcwd chdir fchdir chroot chmod fchmod fchmodat chown fchown fchownat lchown umask getdents
        getdents64
    """,
    "Memory management": """
        mmap munmap mremap mprotect madvise brk sbrk mlock munlock mlockall munlockall mincore membarrier
    """,
    "Process management": """
        fork vfork clone clone3 execve execveat exit exit_group wait4 waitpid waitid getpid gettid getppid
        getpgid setpgid getpgrp setsid getsid getuid geteuid setuid seteuid setreuid setresuid getresuid
        getgid getegid setgid setegid setregid setresgid getresgid setfsuid setfsgid getgroups setgroups prctl
        arch_prctl ptrace seccomp capget capset
    """,
    "Signals": """
        kill tkill tgkill sigaction rt_sigaction sigprocmask rt_sigprocmask sigpending sigsuspend sigaltstack
        sigreturn rt_sigreturn rt_sigqueueinfo rt_tgsigqueueinfo signalfd signalfd4 pause setitimer getitimer
        alarm
    """,
    "Time": """
        time gettimeofday settimeofday clock_gettime clock_settime clock_getres clock_nanosleep nanosleep
        timer_create timer_delete timer_settime timer_gettime timer_getoverrun timerfd_create timerfd_settime
        timerfd_gettime
    """,
    "Sockets": """
        socket socketpair bind listen accept accept4 connect send sendto sendmsg sendmmsg recv recvfrom
        recvmsg recvmmsg shutdown getsockname getpeername setsockopt getsockopt socketcall
    """,
    "IPC": """
        pipe pipe2 shmget shmat shmdt shmctl semget semop semctl msgget msgsnd msgrcv msgctl ipc mq_open
        mq_close mq_unlink mq_send mq_receive futex
    """,
    "Filesystem": """
        mount umount umount2 pivot_root statfs fstatfs sync syncfs quotactl move_mount open_tree fsopen
        fsmount
    """,
    "Event/polling": """
        select pselect6 poll ppoll epoll_create epoll_create1 epoll_ctl epoll_wait epoll_pwait eventfd
        eventfd2 inotify_init inotify_init1 inotify_add_watch inotify_rm_watch
    """,
    "I/O": """
        io_setup io_destroy io_submit io_cancel io_getevents io_uring_setup io_uring_enter io_uring_register
        splice tee vmsplice sendfile copy_file_range
    """,
    "Misc": """
        uname sysinfo syslog getrlimit setrlimit prlimit64 getrusage times sched_yield sched_setscheduler
        sched_getscheduler sched_setparam sched_getparam sched_setaffinity sched_getaffinity setpriority
        getpriority personality getrandom memfd_create set_tid_address set_robust_list get_robust_list rseq
        cacheflush
    """,
}
LIBC = {
    "stdio": """
        printf fprintf sprintf snprintf vprintf vfprintf vsprintf vsnprintf scanf fscanf sscanf fopen fclose
        fread fwrite fgets fputs fgetc fputc getc putc getchar putchar puts gets fseek ftell rewind fflush
        feof ferror clearerr perror fileno fdopen freopen setbuf setvbuf
    """,
    "stdlib": """
        malloc calloc realloc free atoi atol atof strtol strtoul strtoll strtoull strtod strtof rand srand
        abort atexit getenv setenv unsetenv putenv qsort bsearch abs labs llabs div ldiv lldiv
    """,
    "string": """
        strlen strcpy strncpy strcat strncat strcmp strncmp strchr strrchr strstr strtok strtok_r strdup
        strndup strerror strerror_r strcasecmp strncasecmp strspn strcspn strpbrk strsep
    """,
    "memory": """
        memcpy memmove memset memcmp memchr memmem bzero bcopy bcmp
    """,
    "ctype": """
        isalnum isalpha isdigit isxdigit islower isupper isspace isprint iscntrl ispunct isgraph isblank
        tolower toupper
    """,
    "assert": """
        assert __assert_fail
    """,
    "errno": """
        __errno_location
    """,
}
# Prefixes and names of likely macros.
MACRO_PREFIXES = ("pr_", "list_", "list_for_", "hlist_", "atomic_", "READ_ONCE", "WRITE_ONCE", "likely", "unlikely", "container_of", "__")
MACRO_NAMES = ("offsetof", "sizeof", "typeof", "alignof", "NULL", "true", "false", "errno")


def external_rows(syscalls: dict[str, str] = SYSCALLS, libc: dict[str, str] = LIBC) -> list[tuple[str, str, str]]:
    """``(name, kind, summary)`` of every known name."""
    kinds = (("syscall", "system call", syscalls), ("libc", "C library function", libc))
    return [(name, kind, f"{said} {name} ({group.lower()})") for kind, said, groups in kinds for group, names in groups.items() for name in names.split()]


def external_dimension(spark: SparkSession, syscalls: dict[str, str] = SYSCALLS, libc: dict[str, str] = LIBC) -> DataFrame:
    """The known names as ``name, kind, summary``: a few hundred rows."""
    return spark.createDataFrame(external_rows(syscalls, libc), "name string, kind string, summary string")


def is_macro(name: Column | str) -> Column:
    """Whether a name looks like a macro: all capitals, or a known form."""
    name = col(name)
    out = name.rlike("^[A-Z0-9_]+$") | name.isin(*MACRO_NAMES)
    for prefix in MACRO_PREFIXES:
        out |= F.startswith(name, F.lit(prefix))
    return out


def categorized(names: DataFrame, name: str = "raw") -> DataFrame:
    """``names`` with ``kind`` and ``summary`` of the external symbol ``name``.

    In order: a system call behind ``sys_``, a system call, a C library function,
    a likely macro, anything else.
    """
    known = F.broadcast(external_dimension(names.sparkSession))  # a fixed few hundred rows
    calls = known.filter("kind = 'syscall'").select(F.col("name").alias("__n1"), F.col("kind").alias("__k1"), F.col("summary").alias("__s1"))
    every = known.select(F.col("name").alias("__n2"), F.col("kind").alias("__k2"), F.col("summary").alias("__s2"))
    bare = F.when(F.startswith(F.col(name), F.lit("sys_")), F.substr(F.col(name), F.lit(5)))
    met = names.join(calls, bare == F.col("__n1"), "left").join(every, F.col(name) == F.col("__n2"), "left")
    kind = F.coalesce("__k1", "__k2", F.when(is_macro(name), "macro"), F.lit("external"))
    return met.select(*names.columns, kind.alias("kind"), F.coalesce("__s1", "__s2").alias("summary"))

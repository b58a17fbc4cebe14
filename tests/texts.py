"""Our own fixtures."""

MANUAL = """FROB(1)                     User Commands                     FROB(1)

N\bNA\bAM\bME\bE
       frob - show  things   in  a line

SYNOPSIS
       frob [options] [ FILTER ]

DESCRIPTION
       The _\bf_\br_\bo_\bb command shows the set of things that are known, and then re‐
       moves them from /etc/frob.conf with --force=yes.  A set-
       ting is kept.

           frob --all -x /tmp/a | sort > out.txt

OPTIONS
  -a, --all              show all the things that are there
  -b                     be quiet and show
                         only a few of the lines

  -c, --color=WHEN       use the color
      --help   show this help
Flags:
  -z                     zero
"""

LISTING = "src  lib  bin\nopt etc dev\nhome usr var tmp mnt srv run proc sys\n"
PROSE = "This is a `test` of the thing. And it is so.\nThe end is here for all of them."

TOKENS = {
    "a well-known port 1-1024 or 1/2 e.g. and/or a / b / - x": [],
    "use `ls -l` or 'cat' but don't user's": ["`ls -l`", "'cat'"],
    "see https://a.b/c?d=1. Then s/a/b/g <file> ${HOME}/x $1 US$100": ["https://a.b/c?d=1", "s/a/b/g", "<file>", "${HOME}/x", "$1"],
    "--foo=<a b> -- -sS/sT/sA -i[SUFFIX] -1 192.168.0.0/24 fe80::1 18:17:16 host:/dir Nota:veja": ["--foo=<a b>", "--", "-sS/sT/sA", "-i[SUFFIX]", "192.168.0.0/24", "fe80::1", "host:/dir"],
    "~/.ssh/config ./a ../b /dev/disk/by-{label,uuid} *.log conv=notrunc, pid=. systemd.service foo.tar.gz etc.": ["~/.ssh/config", "./a", "../b", "/dev/disk/by-{label,uuid}", "*.log", "conv=notrunc", "pid=", "systemd.service", "foo.tar.gz"],
    "non-headless mode {a|b} [flags]. [1] [see x] string[] yes|no a | b NAME,FSTYPE,LABEL 1,234,567 U:53,111,T:21-25,80 [DD-]hh:mm:ss.": ["non-headless", "{a|b}", "[flags]", "string[]", "yes|no", "NAME,FSTYPE,LABEL", "U:53,111,T:21-25,80", "[DD-]hh:mm:ss"],
    "a `one two three four` b \"must have a tty\" “-” and '\\n'": ["“-”", "'\\n'"],
    "marks ⟦ and ⟧ and '⟦x⟧' and ⟦0⟧": ["'⟦x⟧'"],
    "": [],
}
